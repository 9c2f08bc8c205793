"""Predicates, joins, composite readers, the building graph, sentences, tuning and blocks on small cases."""

from datetime import UTC, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridlake.functions.numerics import bounded_solution
from gridlake.operators import graph as gr
from gridlake.operators import joins as jo
from gridlake.operators import kpi as kp
from gridlake.operators import models as m
from gridlake.operators import predicates as pr
from gridlake.operators import profiles as pf
from gridlake.operators import readers as rd
from gridlake.operators import registry as rg
from gridlake.operators.features import lag_components, last_rows, low_pass
from gridlake.operators.fill import fill_series, gap_islands, integrate_readings
from gridlake.operators.outliers import zscore_outliers
from gridlake.operators.sentences import transform_sentences
from gridlake.sources import series as so

T0 = datetime(2023, 1, 1, tzinfo=UTC)


def test_predicates_are_checked(spark):
    columns = ["a", "b b", "name"]
    for text in ("a > 1 AND name LIKE 'x%'", "`b b` IS NULL", "length(name) BETWEEN 1 AND 3", "a IN (1, 2)"):
        pr.checked(text, columns)
    for text in ("c > 1", "a > 1; DROP TABLE x", "reflect('java.lang.System', 'exit')", "a = (SELECT 1)", "`c` = 1", "a -- x", "java_method(a)"):
        with pytest.raises(ValueError):
            pr.checked(text, columns)


def test_rules_and_columns(spark):
    df = spark.createDataFrame([(1, 5.0, None), (1, None, 2.0), (2, 1.0, 1.0)], "k int, a_price double, b_price double")
    got = {r.k: (r.x_all, r.x_any) for r in pr.rules_by_group(df, ["k"], {"x": "a_price > 0"}).collect()}
    assert got == {1: (False, True), 2: (True, True)}
    names = pr.columns_like(df, "price$")
    rows = df.select(pr.across(df, names, "sum", False).alias("s"), pr.across(df, names, "mean", True).alias("m")).collect()
    assert [tuple(r) for r in rows] == [(None, 5.0), (None, 2.0), (2.0, 1.0)]
    assert pr.rules_by_group(df.limit(0), ["k"], {"x": "a_price > 0"}).count() == 0


def test_null_safe_joins(spark):
    a = spark.createDataFrame([(1, "a"), (None, "n"), (3, "c")], "k int, x string")
    b = spark.createDataFrame([(1, "A"), (None, "N"), (4, "D")], "k int, y string")
    rows = lambda how: sorted(map(str, jo.null_safe_join(a, b, ["k"], how).collect()))
    assert rows("left") == sorted(["Row(k=1, x='a', y='A')", "Row(k=None, x='n', y='N')", "Row(k=3, x='c', y=None)"])
    assert rows("right") == sorted(["Row(k=1, x='a', y='A')", "Row(k=None, x='n', y='N')", "Row(k=4, x=None, y='D')"])
    assert len(rows("full")) == 4 and len(rows("inner")) == 2
    with pytest.raises(ValueError):
        jo.null_safe_join(a, a, ["k"])
    assert [r.k for r in jo.member_of(a, "k", b.select("k")).orderBy("k").collect()] == [None, 1]
    assert [r.k for r in jo.member_of(a, "k", b.select("k"), negate=True).collect()] == [3]
    one = jo.keep_one(spark.createDataFrame([(1, 5, "x"), (1, 6, "y"), (None, 1, None)], "k int, o int, v string"), ["k"], [F.col("o")], last=True)
    assert {r.k: (r.o, r.v) for r in one.collect()} == {1: (6, "y"), None: (1, None)}


def readings(spark, rows):
    at = lambda h: T0 + timedelta(hours=h)
    return spark.createDataFrame([(s, at(a), at(z), v, r) for s, a, z, v, r in rows], "sensor string, start timestamp, end timestamp, value double, isReal boolean")


META = "sensor string, property string, frequency string, regular boolean, cumulative boolean, on_change boolean"


def test_sensor_series(spark):
    rows = [("counter", h, h, 10.0 * h, None) for h in (0, 2, 4, 26)]  # 10 an hour
    rows += [("level", 0, 0, 20.0, True), ("level", 6, 6, 30.0, True), ("level", 12, 12, 50.0, False)]
    rows += [("plain", h, h + 1, 1.0, None) for h in range(24)] + [("unknown", 0, 1, 1.0, None)]
    meta = [("counter", "EnergyConsumption", None, False, True, False), ("level", "Temperature", "PT6H", False, False, True), ("plain", "Gas", "PT1H", True, False, False), ("silent", "Gas", None, None, None, None)]
    got = {(r.sensor, r.time.day): r for r in rd.sensor_series(readings(spark, rows), spark.createDataFrame(meta, META)).collect()}
    assert set(got) == {("counter", 1), ("counter", 2), ("level", 1), ("plain", 1)}
    assert got["counter", 1].value == pytest.approx(240) and got["counter", 2].value == pytest.approx(20) and got["counter", 1].GAPS == 0
    assert got["level", 1].value == pytest.approx(25) and got["level", 1].RATIO == pytest.approx(0.5)  # the estimate is left out
    assert got["plain", 1].value == 24 and got["plain", 1].how == "SUM"
    with_all = {r.sensor: r for r in rd.sensor_series(readings(spark, rows), spark.createDataFrame(meta, META), use_estimated=True).where("sensor = 'level'").collect()}
    assert with_all["level"].value == pytest.approx((20 + 30 + 50) / 3)
    assert rd.sensor_series(readings(spark, []), spark.createDataFrame(meta, META)).count() == 0


def test_device_aggregators(spark):
    series = spark.createDataFrame([(s, T0 + timedelta(days=d), "SUM", v, 0.0, r) for s, d, v, r in (("a", 0, 5.0, 1.0), ("b", 0, 2.0, 1.0), ("a", 1, 4.0, 0.5), ("b", 2, 3.0, 0.8))], "sensor string, time timestamp, how string, value double, GAPS double, RATIO double")
    formulas = spark.createDataFrame([("x", "net", "<mi>a</mi><mo>-</mo><mi> b </mi>", "P1D"), ("x", "odd", "<mi>a</mi><mo>*</mo><mi>b</mi>", "P1D"), ("y", "none", None, None)], "building string, aggregator string, formula string, frequency string")
    got = {r.time.day: r.value for r in rd.device_aggregators(series, formulas, ["P1D", "P1M"]).collect()}
    assert got == {1: 3.0, 3: pytest.approx(-3.75)}  # the day with half its values is dropped
    wide = spark.createDataFrame([(1, 2.0, None), (2, 1.0, 4.0)], "t int, `p.v` double, `q.v` double")
    assert [(r.t, r.v) for r in rd.collapse_columns(wide, {"v": ["p.v", "q.v"]}, "sum").collect()] == [(1, None), (2, 5.0)]


def test_emissions(spark):
    day = lambda d: T0 + timedelta(days=d)
    energy = spark.createDataFrame([(day(0), 10.0, 1.0), (day(1), None, 2.0), (day(2), 5.0, None)], "time timestamp, SUM_Gas double, SUM_xGas double")
    factors = [("Gas", "PT1H", T0 + timedelta(hours=h), 0.5 if h < 24 else 1.0, h) for h in range(48)] + [("Gas", "PT1H", T0, 9.0, -1), ("Gas", "P1M", T0, 7.0, 0), ("Oil", "P1D", T0, 3.0, 0)]
    factors = spark.createDataFrame(factors, "property string, frequency string, start timestamp, value double, registered int")
    got = [r.SUM_EnergyEmissions for r in rd.append_emissions(energy, factors, "Gas", "P1D").orderBy("time").collect()]
    assert got == [5.5, 2.0, None]
    assert [r.SUM_EnergyEmissions for r in rd.append_emissions(energy, factors, "Wood", "P1D").collect()] == [None] * 3
    assert rd.to_aggregatable(energy, "Gas", "All", {"Gas": 2.0}).orderBy("time").first().SUM_All == 20.0


def test_building_graph(spark):
    ns = "http://x.org/s#"
    rows = [("b#1", gr.TYPE, ns + "Building"), ("b#1", ns + "hasSpace", "s"), ("s", ns + "isAssociatedWithElement", "e"), ("b#2", gr.TYPE, ns + "Building"), ("k", ns + "hasSeries", "old"), ("k", ns + "hasSeries", "new"), ("new", ns + "isEstimatedByModel", "m"), ("m", ns + "modelDate", "2020-01-01")]
    t = spark.createDataFrame([(*r, "uri", None) for r in rows], gr.SCHEMA)
    assert [(r.building, r.element, r.measure) for r in rg.measures(t, ns).collect()] == [("b#1", "e", None)]
    assert [tuple(r) for r in rg.indicator_series(t, ns).collect()] == [("k", "new")]
    assert rg.exists(t, [("?x", gr.TYPE, ns + "Building")]) and not rg.exists(t, [("?x", gr.TYPE, ns + "Model")])
    assert rg.attributes(t, rg.subjects_of(t, ns + "Building").select("subject"), "subject", {"space": [ns + "hasSpace"]}).where("space IS NULL").count() == 1
    assert rg.measures(t.limit(0), ns).count() == 0
    values = spark.createDataFrame([("b", "use", 10.0), ("b", "area", 4.0), ("c", "use", 3.0), ("c", "area", 0.0), ("d", "use", 2.0)], "building string, kpi string, value double")
    got = {r.building: r.rated for r in rg.kpi_by_building(values, spark.createDataFrame([("use", "area")], "kpi string, by string")).where("kpi = 'use'").collect()}
    assert got == {"b": 2.5, "c": 0.0, "d": 2.0}


def test_turtle(spark, tmp_path):
    text = '@prefix x: <http://x.org/> . # note\nx:a a x:B ; x:p "q\\"; .", \'\'\'\'\' , 2.5 ;\n x:n "1"^^x:int , "hi"@en ; .\n<rel> x:t true .\n_:n x:p x:a.\n'.replace("'''''", "'s'")
    (tmp_path / "a.ttl").write_text("@base <http://y.org/> .\n" + text)
    got = {(r.s, r.p, r.o, r.o_type) for r in gr.read_turtle(spark, str(tmp_path / "a.ttl")).collect()}
    x = "http://x.org/"
    assert got == {(x + "a", gr.TYPE, x + "B", "uri"), (x + "a", x + "p", 'q"; .', "literal"), (x + "a", x + "p", "s", "literal"), (x + "a", x + "p", "2.5", "literal"), (x + "a", x + "n", "1", "literal"), (x + "a", x + "n", "hi", "literal"), ("http://y.org/rel", x + "t", "true", "literal"), ("_:n", x + "p", x + "a", "uri")}
    with pytest.raises(ValueError):
        list(gr.parse_turtle("<a> <b> [ <c> <d> ] ."))


def test_holiday_files_and_lock(spark, tmp_path):
    (tmp_path / "2024").mkdir()
    (tmp_path / "2024" / "ES").write_text('[{"date": "2024-01-06"}]')
    assert so.holiday_client(f"file://{tmp_path}")(2024, "ES") == [{"date": "2024-01-06"}]
    store = so.KeyedStore(spark, str(tmp_path / "store"), "k")
    store.upsert(spark.createDataFrame([(1, "a")], "k int, v string"))
    (tmp_path / "store" / "writing.lock").touch()
    with pytest.raises(Exception):  # noqa: B017 - a Java exception
        store.upsert(spark.createDataFrame([(1, "b")], "k int, v string"))
    assert store.find(1).first().v == "a"


def test_blocks_equal_whole_series(spark):
    """Values with gaps over months: what crosses a block's edge is carried on."""
    rng = np.random.default_rng(3)
    t = np.sort(rng.choice(24 * 200, 700, replace=False))
    v = [None if rng.random() < 0.4 else float(round(100 + 10 * rng.normal(), 2)) for _ in t]
    df = spark.createDataFrame([(None if k else "s", T0 + timedelta(hours=int(h)), x, 7) for k in (0, 1) for h, x in zip(t, v, strict=True)], "k string, time timestamp, value double, _g int")
    import pandas as pd

    s = pd.Series(v, dtype=float)
    for method, want in (("forward", s.ffill()), ("backward", s.bfill()), ("linear", s.interpolate(limit_direction="both"))):
        got = fill_series(df.drop("_g"), ["k"], method).orderBy("k", "time").toPandas()
        assert np.allclose(got.value, pd.concat([want, want]), equal_nan=True)
    nxt = integrate_readings(df.drop("_g"), ["k"], "onChange").orderBy("k", "time").toPandas()
    assert np.allclose(nxt.value[:700], s.shift(-1), equal_nan=True)
    isl = gap_islands(df.drop("_g"), ["k"], "P1D").orderBy("k", "time").toPandas()
    assert (isl.island[:700].to_numpy() == np.cumsum(np.diff(t, prepend=t[0]) > 24)).all()
    y, want = None, []
    for x in v:
        y = None if x is None else 0.9 * (y or 0.0) + 0.1 * x
        want.append(np.nan if y is None else y)
    lp = low_pass(df.drop("_g"), ["k"], ["value"], 0.9).orderBy("k", "time").toPandas()
    assert np.allclose(lp.value_lpf[:700].astype(float), want, equal_nan=True)


def test_low_pass_is_linear_in_a_block(spark):
    import time

    df = spark.range(40_000).select(F.lit("s").alias("k"), F.timestamp_seconds(F.col("id")).alias("time"), F.col("id").cast("double").alias("value"))
    low_pass(df.limit(10), ["k"], ["value"], 0.9).count()
    began = time.perf_counter()
    assert low_pass(df, ["k"], ["value"], 0.5).agg(F.max("value_lpf")).first()[0] == pytest.approx(39_998, abs=0.1)
    assert time.perf_counter() - began < 20


def test_bounded_solution():
    rng = np.random.default_rng(1)
    for _ in range(30):
        x = rng.normal(size=(40, 5)) * 10.0 ** rng.integers(-3, 4, 5)
        y = x @ (rng.normal(size=5) / 10.0 ** rng.integers(-3, 4, 5)) + rng.normal(size=40)
        positive = rng.random(5) < 0.6
        beta = bounded_solution(x.T @ x, x.T @ y, positive)
        pull = (x.T @ y - x.T @ x @ beta) / np.linalg.norm(x, axis=0)
        assert (beta[positive] >= 0).all() and np.abs(pull[beta != 0]).max() < 1e-6 * np.linalg.norm(y) and (pull[positive & (beta == 0)] <= 1e-6 * np.linalg.norm(y)).all()


def test_disruptive_period(spark):
    days = [(k, T0 + timedelta(days=d), 15 - 10 * np.cos(2 * np.pi * d / 365), (4.0 if k == "b" or not 70 <= d <= 130 else 1.5) + 0.01 * (d % 7)) for k in "ab" for d in range(500)] + [("c", T0, 1.0, 1.0), (None, T0, None, None)]
    df = spark.createDataFrame([(k, t, float(w), float(v)) if w is not None else (k, t, None, None) for k, t, w, v in days], "k string, time timestamp, temperature double, value double")
    got = {r.k: r for r in m.disruptive_period(df, ["k"], ("2023-02-20", "2023-04-15"), ("2023-04-20", "2023-06-15"), "UTC").collect()}
    assert (got["a"].start, got["a"].end) == (datetime(2023, 3, 12), datetime(2023, 5, 11)) and got["a"].change < -50
    assert all(got[k].start is None for k in ("b", "c", None))


def test_tuning_and_recursion(spark):
    rows = [(s, T0 + timedelta(hours=h), float(h % 12 > 6) * 5 + 1, h % 12) for s in "ab" for h in range(200)]
    df = spark.createDataFrame(rows, "s string, time timestamp, value double, h int")
    terms = lambda g: {"one": F.lit(1.0), "late": (F.col("h") > g["after"]).cast("double")}
    scores, best = m.tune_linear(df, ["s"], m.input_grid({"after": [3, 6, 9]}), terms, "value", 60, 24, 23)
    assert {r.params for r in best.collect()} == {'{"after": 6}'} and scores.count() == 6 and scores.first().folds == 5
    assert len(m.input_grid({"a": [1, 2, 3], "b": [1, 2]}, 4)) == 4
    linear = lambda d: d.withColumn("predicted", F.col("value_l12"))
    got = m.recursive_forecast(df, linear, ["s"], "value", [12], 30).orderBy("s", "time").toPandas()
    assert len(got) == 60 and np.allclose(got.predicted[:30], [float(h % 12 > 6) * 5 + 1 for h in range(170, 200)])
    boxcox = m.autoregressive(df, ["s"], [], "value", [12], 24, boxcox=0.5, status="h").toPandas()
    assert np.allclose(boxcox.sort_values(["s", "time"]).predicted[:24], [float(h % 12 > 6) * 5 + 1 for h in range(176, 200)], atol=1e-3)


def test_state_as_text():
    state = {"limits": {"a": [0.0, 1.5]}, "lambda": None}
    assert m.unserialise(m.serialise(state)) == state and m.unserialise("zz") is None and m.unserialise(None) is None and m.unserialise("00ff") is None


def test_saved_model(spark, tmp_path):
    df = spark.createDataFrame([(float(i), 3.0 * i + 1) for i in range(50)], "x double, y double")
    m.save_model(m.fit_linear(df, [m.Feature("x", expr="x")], "y"), str(tmp_path / "model"))
    assert m.predict(m.load_model(str(tmp_path / "model")), df).agg(F.max(F.abs(F.col("predicted") - F.col("y")))).first()[0] < 1e-5


def test_intervals_of_buckets(spark):
    df = spark.createDataFrame([("s", T0 + timedelta(hours=h), 10.0, 1.0) for h in range(24)], "s string, time timestamp, predicted double, sigma double")
    for floor in (None, 0.0):
        r = m.prediction_intervals(df, ["s"], "P1D", draws=2000, floor=floor).first()
        assert abs(r.mean - 240) < 1 and abs(r.sd - 24**0.5) < 0.4 and abs(r.q97_5 - 240 - 1.96 * 24**0.5) < 0.7


def test_sentences_and_allocation(spark):
    df = spark.createDataFrame([("s", T0 + timedelta(hours=h), float(h), "x" if h % 2 else None) for h in range(4)], "k string, time timestamp, v double, c string")
    got, names = transform_sentences(df, {"twice": "v * 2", "past": "lags(twice, 1)", "kind": "dummies(c, x)", "soft": "lowpass(v, 0.5)"}, ["k"])
    assert names == {"twice": ["twice"], "past": ["past_l1"], "kind": ["kind_x"], "soft": ["soft"]}
    assert [(r.past_l1, r.kind_x, r.soft) for r in got.orderBy("time").collect()] == [(None, 0.0, 0.0), (0.0, 1.0, 0.5), (2.0, 0.0, 1.25), (4.0, 1.0, 2.125)]
    with pytest.raises(ValueError):
        transform_sentences(df, {"bad": "system(v)"}, ["k"])
    a = kp.allocate(spark.createDataFrame([(1, 3.0, 8.0), (1, 1.0, 8.0), (2, None, 6.0), (2, 5.0, 6.0), (3, 0.0, 2.0)], "k int, w double, v double"), ["k"], F.col("w"), "v")
    assert sorted((r.k, r.allocated) for r in a.collect()) == [(1, 2.0), (1, 6.0), (2, 3.0), (2, 3.0), (3, 2.0)]


def test_day_features_and_clusters(spark):
    rng = np.random.default_rng(0)
    rows = []
    for d in range(60):
        for h in range(24):
            peak = 8 if d % 7 >= 5 else 17
            rows.append(("s", T0 + timedelta(hours=24 * d + h), float(1 + 4 * np.exp(-0.5 * ((h - peak) / 2) ** 2) + 0.02 * rng.normal()), float(10 + 8 * np.sin(d / 9))))
    df = spark.createDataFrame(rows, "s string, time timestamp, value double, temperature double")
    days = pf.day_features(df, ["s"], "UTC", 8, bases=[18.0])
    assert days.count() == 60 and days.where("hdd18 < 0 OR cdd18 < 0").count() == 0
    inputs = [f"part_{k:02d}" for k in range(8)]
    scaled, scaling = pf.scale_features(days, ["s"], inputs)
    got, centres = pf.cluster_features(scaled, "s", inputs, ignore=["2023-01-03"])
    by = got.withColumn("late", F.weekday("date") < 5).toPandas()
    assert by.cluster.isna().sum() == 1 and centres.agg(F.sum("days")).first()[0] == 59
    assert pf.scale_features(days, ["s"], inputs, scaling=scaling)[0].count() == 60
    assert pf.day_signatures(days, ["s"]).where("tbal IS NOT NULL AND slopeHdd >= 0").count() == 60
    assert pf.day_features(df.limit(0), ["s"], "UTC").count() == 0


def test_lags_begin_with_rows_kept(spark):
    df = spark.createDataFrame([("s", T0 + timedelta(hours=h), float(h), "x") for h in range(6)], "k string, time timestamp, v double, extra string")
    kept = last_rows(df.where("v < 4"), ["k"], ["v"], 2)
    got = lag_components(df.where("v >= 4"), ["k"], ["v"], [1, 2], before=kept).orderBy("time").collect()
    assert [(r.v, r.v_l1, r.v_l2, r.extra) for r in got] == [(4.0, 3.0, 2.0, "x"), (5.0, 4.0, 3.0, "x")]
    assert lag_components(df, ["k"], ["v"], [1], force={"v": F.lit(9.0)}).where("v_l1 = 9").count() == 5


def test_lags_and_rolling_scores_in_blocks_of_rows(spark):
    """More rows than a block of rows holds, ties included: lags and trailing windows reach over its edge."""
    import pandas as pd

    rng = np.random.default_rng(5)
    v = np.round(rng.normal(size=45_000), 3)
    pdf = pd.DataFrame({"k": "s", "time": pd.Timestamp("2023-01-01", tz="UTC") + pd.to_timedelta(np.arange(45_000) * 60, unit="s"), "v": v})
    df = spark.createDataFrame(pdf)
    got = lag_components(df, ["k"], ["v"], [1, 30], extend=True).orderBy("time").toPandas()
    assert np.allclose(got.v_l30, pd.Series(v).shift(30).fillna(v[0])) and len(got) == 45_000
    flags = zscore_outliers(df.withColumnRenamed("v", "value"), ["k"], 2.0, "PT1H", "PT1M").orderBy("time").toPandas().outlier
    roll = pd.Series(v).rolling(60, min_periods=1)
    z = ((pd.Series(v) - roll.mean()) / roll.std()).to_numpy()
    z[0] = z[1]
    assert (flags.to_numpy(dtype=bool) == (np.abs(z) >= 2)).mean() > 0.9999
