"""Graph, sources, stores, sensors, indicators, models and streams on small cases."""

import numpy as np
import pytest
from conftest import column
from pyspark.sql import functions as F

from gridlake.operators import graph as gr
from gridlake.operators import kpi as kp
from gridlake.operators import models as m
from gridlake.operators import profiles as pf
from gridlake.operators import sensors as se
from gridlake.sources import series as so
from gridlake.streaming import series as ss

K = ["series_id"]


def test_graph_round_trip(spark, tmp_path):
    none = spark.createDataFrame([], gr.SCHEMA)
    items = spark.createDataFrame([("http://x.org/b#1", 'say "hi"\n\\', 2.5, "http://x.org/s#1"), ("http://x.org/b#2", None, 1.0, None)], "s string, name string, area double, space string")
    t = gr.add_item(none, items, "s", ["http://x.org/Building"], {"http://x.org/name": "name", "http://x.org/area": "area"}, {"http://x.org/hasSpace": "space"})
    assert t.count() == 6
    gr.ntriples(t).coalesce(1).write.text(str(tmp_path / "nt"))
    back = gr.read_ntriples(spark, str(tmp_path / "nt"))
    drop = lambda df: sorted((r.s, r.p, r.o, r.o_type) for r in df.collect())
    assert drop(back) == drop(t)
    assert gr.turtle(t, {"b": "http://x.org/b#"}).count() == 2
    assert column(gr.match(t, [("?b", gr.TYPE, "http://x.org/Building"), ("?b", "http://x.org/hasSpace", "?s")]), "s", "s") == ["http://x.org/s#1"]


def test_building_facts(spark):
    ns = "x:"
    rows = [("m", "p", "o")][:0] + [("b", "x:hasSpace", "s"), ("s", "x:isObservedByDevice", "d"), ("d", "x:hasSensor", "n"), ("n", "x:hasMeasurement", "m"), ("s", "x:hasArea", "a"), ("a", "x:areaType", "GrossFloorArea"), ("a", "x:areaValue", "40.5"), ("b", "x:hasLocationInfo", "l"), ("l", "x:addressTimeZone", "Europe/Madrid")]
    t = spark.createDataFrame([(*r, "uri", None) for r in rows], gr.SCHEMA)
    assert [tuple(r) for r in se.building_facts(t, ns).collect()] == [("b", "s", "d", "n", "Europe/Madrid", 40.5)]


def test_sources_and_store(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"h1": [{"start": "2020-01-01T00:00:00Z", "end": "2020-01-01T01:00:00Z", "value": 1.5}], "h2": []}')
    (tmp_path / "h3.tsv").write_text("start\tend\tvalue\tisReal\n2020-01-01T00:00:00Z\t2020-01-01T01:00:00Z\tx\t\n")
    (tmp_path / "s.csv").write_text("2020-03-01 00:00:00+00:00;0.1\n")
    assert [(r.sensor_id, r.value, r.isReal) for r in so.read_json_series(spark, str(tmp_path / "a.json")).collect()] == [("h1", 1.5, None)]
    assert [(r.sensor_id, r.value, r.isReal) for r in so.read_tsv_series(spark, str(tmp_path / "h3.tsv")).collect()] == [("h3", None, False)]
    assert so.read_csv_series(spark, str(tmp_path / "s.csv")).first().value == 0.1
    store = so.KeyedStore(spark, str(tmp_path / "store"), "k")
    assert store.read() is None
    store.upsert(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"))
    store.upsert(spark.createDataFrame([("b", 3)], "k string, v int"))
    assert sorted(map(tuple, store.read().collect())) == [("a", 1), ("b", 3)] and store.find("b").first().v == 3


def test_sensor_intervals(spark, series):
    df = series([0, 10, 990, 5], 5400).withColumnRenamed("time", "start").withColumn("end", F.lit(None).cast("timestamp"))
    got = se.interval_ends(df, K, F.lit(False), F.lit(True), "PT1H")
    assert column(got, "value", "start") == [10, 980, 15]
    grid = se.intervals_to_grid(got, K, "PT1H", "SUM")
    assert abs(sum(column(grid, "value")) - 1005) < 1e-9 and column(grid, "covered") == [1, 1, 1, 1, 0.5]
    client = lambda y, c: [{"date": f"{y}-01-01"}, {"date": f"{y}-09-11", "counties": ["ES-CT"]}]
    assert se.holiday_table(spark, client, [2020, 2021], "ES").count() == 2 and se.holiday_table(spark, client, [2020], "ES", "CT").count() == 2


def test_indicators(spark, series):
    c, b, a, f = (F.lit(float(x)) for x in (10, 12, 4, 0.5))
    one = spark.range(1).select(*[kp.indicator(n, c, b, a, f, F.lit(2.0)).alias(n) for n in ("EnergyUse", "EnergyUseIntensity", "EnergyUseSavings", "EnergyUseSavingsRelative", "EnergyEmissionsSavings", "HeatingDegreeDays")]).first()
    assert tuple(one) == (10, 2.5, 2, 20, 1, 0)
    got = kp.longitudinal_indicators(series([1] * 40), K, {"EnergyUse": F.col("value")}, ["P1D"]).collect()
    assert [(r.start, r.end, r.value, r.isReal) for r in got] == [("2020-01-01T00:00:00Z", "2020-01-01T23:59:59Z", 24, True)]


def test_models(spark, series):
    rng = np.random.default_rng(0)
    rows = [("a", i, 1.0, float(x), float(2 + 3 * x + 0.01 * rng.normal())) for i, x in enumerate(rng.uniform(0, 1, 400))]
    df = spark.createDataFrame(rows, "series_id string, time bigint, one double, x double, y double")
    coef = {r.term: r.coefficient for r in m.penalised_linear(df, K, ["one", "x"], "y", ["x"]).collect()}
    assert abs(coef["one"] - 2) < 0.01 and abs(coef["x"] - 3) < 0.02
    model = m.fit_linear(df, [m.Feature("one", expr="one"), m.Feature("x", expr="x")], "y")
    got = m.regression_metrics(m.predict(model, df, low=0.0), "y", "predicted").first()
    assert got.R2 > 0.999 and got.RMSE > -0.02
    last = m.recursive_coefficients(df, K, ["one", "x"], "y", 1.0).orderBy(F.desc("time")).first()
    assert abs(last.one - 2) < 0.01 and abs(last.x - 3) < 0.02
    wave = series([10 + 5 * np.sin(i * np.pi / 12) for i in range(200)])
    p = column(m.autoregressive(wave, K, [], "value", [1, 2], 24), "predicted")
    assert np.allclose(p, [10 + 5 * np.sin(i * np.pi / 12) for i in range(176, 200)], atol=1e-6)
    q = m.prediction_intervals(wave.select("series_id", "time", F.lit(1.0).alias("predicted"), F.lit(0.5).alias("sigma")), K, "P1D", draws=400).orderBy("time").first()
    assert abs(q["mean"] - 24) < 0.5 and abs(q["sd"] - 0.5 * 24**0.5) < 0.4
    folds = m.time_slices(wave, K, 50, 10, 9, 3).groupBy("fold", "part").count().orderBy("fold", "part").collect()
    assert [r["count"] for r in folds] == [10, 50, 10, 60, 10, 70]


@pytest.mark.parametrize("fixed", [False, True])
def test_time_slices_to_the_end(series, fixed):
    df = series(range(203)).unionByName(series(range(75), name="b")).unionByName(series(range(59), name="short"))
    want = []
    for name, size in (("a", 203), ("b", 75)):
        for k, end in enumerate(range(50, size - 10 + 1, 7)):
            want += [(name, k, "train", i) for i in range(end - 50 if fixed else 0, end)] + [(name, k, "test", i) for i in range(end, end + 10)]
    got = m.time_slices(df, K, 50, 10, 6, fixed=fixed).select("series_id", "fold", "part", "value").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_cluster_days_of_any_length_and_number(spark):
    """Days of 23 and 25 hours and with NULL hours are clustered; kinds keep their label beyond a block of days."""
    rng, hour = np.random.default_rng(3), np.arange(24)
    base = [1 + 2 * np.exp(-0.5 * ((hour - at) / 2) ** 2) for at in (6, 13, 20)]
    rows, kind = [], {}
    for g, n in (("large", 390), ("small", 60)):
        for _ in range(n):
            i = len(rows)
            q = [float(v) for v in base[i % 3] * (1 + 0.02 * rng.normal(size=24))]
            if i % 20 == 3:
                q = q[:2] + q[3:]
            if i % 20 == 7:
                q = q[:3] + q[2:]
            if i % 20 == 11:
                q[int(rng.integers(24))] = None
            kind[i] = (g, i % 3)
            rows.append((g, i, q))
    rows += [("large", 1000, None), ("large", 1001, [None] * 24), ("small", 1002, [0.0] * 24)]
    got = {r.i: (r.g, r.cluster) for r in pf.cluster_days(spark.createDataFrame(rows, "g string, i bigint, q array<double>"), "g", "i", "q", block=100).collect()}
    assert len(got) == len(rows) and all(got[i][1] is None for i in (1000, 1001, 1002))
    assert len({(k, got[i]) for i, k in kind.items()}) == 6 and len({got[i] for i in kind}) == 6 and None not in {got[i][1] for i in kind}


def test_profiles(spark, series):
    rng = np.random.default_rng(1)
    t = rng.uniform(-5, 35, 400)
    v = 50 + 6 * np.maximum(14 - t, 0) + 5 * np.maximum(t - 24, 0) + rng.normal(0, 1, 400)
    df = series(v, 86400).join(series(t, 86400, column="temperature"), ["series_id", "time"])
    got = pf.change_points(df, K, "UTC").first()
    assert got.heating and got.cooling and 10 < got.tbalh < 18 and 20 < got.tbalc < 28
    days = pf.load_curve_matrix(series(range(48)), K, "UTC", 4, relative=False).orderBy("date").collect()
    assert [days[0][f"part_{k:02d}"] for k in range(4)] == [15, 51, 87, 123]
    s = pf.affinity(pf.similarity(np.array([[0.0], [0.1], [5.0], [5.1]])), 1)
    assert s[0, 1] > 0 and s[0, 2] == 0


def test_streams(spark, series, tmp_path):
    src = str(tmp_path / "in")
    series(range(1, 11), 600).write.parquet(src)
    stream = spark.readStream.schema("series_id string, time timestamp, value double").parquet(src)
    for name, df, mode in (("lpf", ss.stream_low_pass(stream, "series_id", 0.5), "append"), ("win", ss.stream_resample(stream, K, "1 hour", "1 hour"), "complete")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp_path / name)).start()
        q.awaitTermination(120)
    got = column(spark.table("lpf"), "value_lpf")
    assert [round(x, 4) for x in got[:4]] == [0.5, 1.25, 2.125, 3.0625]
    assert column(spark.table("win"), "SUM") == [21, 34]


def test_levels_and_day_kinds(spark, series):
    rng = np.random.default_rng(2)
    df = series(np.concatenate([rng.normal(10, 1, 300), rng.normal(50, 2, 300)]))
    got = [r.above for r in pf.consumption_levels(df, K).orderBy("level").collect()]
    assert len(got) == 2 and 15 < got[1] < 45
    days = spark.sql("SELECT explode(sequence(date'2024-01-01', date'2024-06-30')) AS date").withColumn("kind", F.when(F.weekday("date") >= 5, "off").otherwise("on")).withColumn("x", F.when(F.dayofmonth("date") != 9, F.when(F.weekday("date") >= 5, 1.0).otherwise(5.0)))
    centres = spark.createDataFrame([("off", 1.0), ("on", 5.0)], "s string, x double")
    out = pf.classify_days(days, centres, ["x"], "s", pf.calendar_classifier(days, "kind")).collect()
    assert all(r.s == r.kind for r in out) and {r.by for r in out} == {"curve", "calendar"}
