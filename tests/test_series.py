"""Golden vectors of the series operators."""

import math

import pytest
from conftest import column
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gridlake.functions.numerics import nonnegative_least_squares, quantile_regression, recursive_least_squares
from gridlake.functions.period import Period, hourly_timesteps, seconds
from gridlake.operators import features as fe
from gridlake.operators import fill as fi
from gridlake.operators import joins as jo
from gridlake.operators import outliers as ou
from gridlake.operators import resample as rs
from gridlake.operators.tuning import Setting, decode, encode, gray, optimise, ungray

K = ["series_id"]


def test_periods():
    assert seconds("PT15M") == 900 and seconds("3H") == 10800 and seconds("P1H") == 3600 and seconds("P1M") == 2_629_800
    assert Period.parse("PT1H30M").text() == "1 hour, 30 mins" and Period.parse("P1DT2H").text(True) == "1 day"
    assert hourly_timesteps(1, "PT15M") == 4 and hourly_timesteps(730.5, "PT1H") == 731
    with pytest.raises(ValueError):
        Period.parse("soon")


@pytest.mark.parametrize(("step", "n", "want"), [(3600, 97, "PT1H"), (86400, 93, "P1D"), (604800, 40, "P1W"), (60, 20, "PT1M"), (1, 20, "PT1S")])
def test_time_step(series, step, n, want):
    assert column(rs.detect_time_step(series([0.1] * n, step), K), "timestep", "series_id") == [want]


def test_time_step_calendar_and_short(spark, series):
    months = spark.sql("SELECT 'm' AS series_id, explode(sequence(timestamp'2020-03-01', timestamp'2020-11-01', interval 1 month)) AS time")
    assert column(rs.detect_time_step(months, K), "timestep", "series_id") == ["P1M"]
    assert column(rs.detect_time_step(series([1]), K), "timestep", "series_id") == [None]
    assert rs.detect_time_step(series([1]).limit(0), K).count() == 0


def test_min_max(series):
    values = [10, 1, 10, 1, 10, 20, 10, 20, 10, None]
    got = column(ou.min_max_outliers(series(values), K, 5, 15), "outlier")
    assert got == [False, True, False, True, False, True, False, True, False, None]


def test_min_max_daily_bounds_hold_until_the_next(series):
    got = column(ou.min_max_outliers(series([10] * 48), K, low_series=series([10, 10, 12], 86400), high_series=series([8, 10, 12], 86400)), "outlier")
    assert got == [True] * 24 + [False] * 24


def test_zscore(series):
    values = [5] * 12 + [10] * 12 + [5] * 12 + [10] * 12
    assert not any(column(ou.zscore_outliers(series(values), K, 2.0), "outlier"))
    assert all(column(ou.zscore_outliers(series(values), K, 0.5), "outlier"))


def test_static(spark):
    c = F.col("v")
    df = spark.createDataFrame([(i, v) for i, v in enumerate([10, 10, 15, 15, 10, 10])], "i int, v int")
    assert not any(column(df.select("i", ou.static_min_max(c, 10, 15).alias("o")), "o", "i"))
    assert all(column(df.select("i", ou.static_min_max(c, 10, 15, False, False).alias("o")), "o", "i"))
    t = spark.createDataFrame([(i, v) for i, v in enumerate(["abc", "def", "ghi", None])], "i int, v string")
    assert column(t.select("i", ou.static_regexp(c, ["ab.", ".ef"]).alias("o")), "o", "i") == [True, True, False, False]
    assert column(t.select("i", ou.static_regexp(c, ["ab.", ".ef"], True).alias("o")), "o", "i") == [False, False, True, True]


@pytest.mark.parametrize(("method", "want"), [("linear", 3), ("forward", 2), ("backward", 4)])
def test_fill(series, method, want):
    values = [None if i == 3 else i for i in range(1, 98)]
    assert column(fi.fill_series(series(values), K, method, "2H"), "value")[2] == want


def test_fill_leaves_long_gaps(series):
    values = [None if i in (3, 4, 5) else i for i in range(1, 98)]
    got = column(fi.fill_series(series(values), K, "backward", "2H"), "value")
    assert got[2:5] == [None] * 3 and got[1] == 2


def test_integrate(series):
    assert column(fi.integrate_readings(series([5, 7, 8, 10, 11, 16, 20]), K, "onChange"), "value") == [7, 8, 10, 11, 16, 20, None]
    assert column(fi.integrate_readings(series([5, 6, 8, 2, 3, 5, 8]), K, "cumulative"), "value") == [1, 2, 4, 1, 2, 3, None]
    assert column(fi.integrate_readings(series([5, 6, 8, 2, 3, 5, 800, 3, 5, 8]), K, "cumulative"), "value") == [1, 2, 4, 1, 2, 795, 203, 2, 3, None]


def test_align(series):
    two = series([1] * 24 + [2] * 24).withColumn("isReal", F.lit(True))
    got = rs.align_time_grid(two, K, "P1D", ["SUM", "AVG"], "PT1H").orderBy("time").collect()
    assert [(r["SUM"], r["AVG"], r["GAPS"], r["RATIO"]) for r in got] == [(24, 1, 0, 1), (48, 2, 0, 1)]
    got = rs.align_time_grid(series([5] * 12 + [10] * 12 + [2] * 24), K, "P1D", ["AVG", "MIN", "MAX"], "PT1H").orderBy("time").collect()
    assert [(r["AVG"], r["MIN"], r["MAX"]) for r in got] == [(7.5, 5, 10), (2, 2, 2)]
    got = rs.align_time_grid(series([1] * 60, 86400), K, "P1M", ["SUM"], "P1D").orderBy("time").collect()
    assert [(r["SUM"], r["RATIO"]) for r in got] == [(31, 1), (29, 1)]
    assert column(rs.align_time_grid(series([1] * 60 + [2] * 60, 60), K, "P1H", ["SUM"], "PT1M"), "SUM") == [60, 120]


def test_resample_conserves_mass(series):
    got = rs.resample_and_aggregate(series(range(48)), K, "P1D", "SUM")
    assert sum(column(got, "value")) == sum(range(48)) and all(column(got, "isReal"))
    with pytest.raises(ValueError):
        rs.resample_and_aggregate(series([1]), K, "P1D", "MODE")


@pytest.mark.parametrize("chunk", ["PT2H", "PT3H", "P30D"])
def test_low_pass(series, chunk):
    got = column(fe.low_pass(series(range(1, 11)), K, ["value"], 0.5, chunk=chunk), "value_lpf")
    assert [round(v, 6) for v in got] == [0.5, 1.25, 2.125, 3.0625, 4.03125, 5.015625, 6.007812, 7.003906, 8.001953, 9.000977]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(-100, 100)), min_size=1, max_size=20))
def test_low_pass_restarts_after_null(series, values):
    want, y = [], None
    for x in values:
        y = None if x is None else 0.3 * (y or 0.0) + 0.7 * x
        want.append(y)
    got = column(fe.low_pass(series(values), K, ["value"], 0.3, chunk="PT4H"), "value_lpf")
    assert all((a is None) == (b is None) and (a is None or abs(a - b) < 1e-9) for a, b in zip(got, want, strict=True))


def test_calendar(spark):
    df = spark.sql("SELECT explode(array(timestamp'2020-01-01 00:00:00', timestamp'2020-04-01 21:59:59', timestamp'2020-12-27 00:00:00')) AS time")
    a, b, c = fe.calendar_components(df, "Europe/Madrid", holidays=["2020-12-27"]).orderBy("time").collect()
    assert (a.weekday, a.dayYear, a.season, a.hour, a.hourBy3, a.timestamp, a.weekhour) == (3, 1, "Winter", 1, 1, 1577836800, 49)
    assert (str(b.date), b.dayYear, b.season, b.hour, b.hourBy8, b.hourBy6, b.hourBy4, b.hourBy3, b.minute, b.second) == ("2020-04-01", 92, "Spring", 23, 3, 4, 6, 8, 59, 59)
    assert (c.weekday, c.isWeekend, c.isHolidays, c.dayYear) == (7, True, True, 362)


def test_degrees(spark, series):
    t = spark.createDataFrame([(i, float(v)) for i, v in enumerate(range(18, 25))], "i int, v double")
    assert column(t.select("i", fe.degree_raw(F.col("v"), F.lit(21.0), "heating", 0).alias("d")), "d", "i") == [3, 2, 1, 0, 0, 0, 0]
    assert column(t.select("i", fe.degree_raw(F.col("v"), F.lit(21.0), "heating").alias("d")), "d", "i")[0] == 5
    days = series([25] * 12 + [27] * 12 + [26] * 12 + [28] * 12, start="2020-01-01 23:00:00")
    assert column(fe.degree_days(days, K, "value", [25], "cooling", "Europe/Madrid", hysteresis=0), "degreeDays25") == [1, 2]
    month = series([25] * 10 + [26] * 10 + [28] * 11, 86400)
    assert column(fe.degree_days(month, K, "value", [25], "cooling", "UTC", "P1M", 0), "degreeDays25") == [43]


def test_normalise(spark, series):
    df = spark.createDataFrame([(i, float(v), 1.0) for i, v in enumerate([0, 25, 100])], "i int, v double, flat double")
    got, limits = fe.normalise_range(df, ["v", "flat"])
    assert column(got, "v", "i") == [0, 0.25, 1] and column(got, "flat", "i") == [0, 0, 0] and limits["v"] == (0, 100)
    values = series([10] * 12 + [20] * 12 + [5] * 12 + [10] * 12)
    got = column(fe.normalise_daily(values, K, "value", "UTC"), "value")
    assert abs(got[0] - 10 / 360) < 1e-9 and abs(sum(got) - 2) < 1e-9
    got, scale = fe.normalise_zscore(values, ["value"])
    assert abs(column(got, "value")[0] + 0.2270134) < 1e-6 and abs(scale["value"][1] - 5.506283) < 1e-5


@settings(max_examples=4, deadline=None)
@given(st.floats(-2, 2))
def test_boxcox_round_trip(spark, lam):
    df = spark.createDataFrame([(0.5,), (1.0,), (30.0,)], "v double")
    for r in df.select("v", fe.boxcox_inverse(fe.boxcox(F.col("v"), lam), lam).alias("x")).collect():
        assert r.x is None or math.isclose(r.x, r.v, rel_tol=1e-4)


def test_nearest_and_formula(series):
    got = jo.nearest_join(series(range(10)), series([0, 100], 18000, column="c"), K, ["c"])
    assert column(got, "c") == [0, 0, 0, 100, 100, 100, 100, 100, 100, 100]
    both = series([1, None, 3], name="x").unionByName(series([10, 20], name="y"))
    assert column(jo.aggregate_formula(both, "<mi>x</mi><mo>+</mo><mi>y</mi>", "series_id"), "value") == [11, 20, 3]
    assert column(jo.aggregate_formula(both, "<mi>x</mi><mo>*</mo><mi>y</mi><mo>-</mo><mn>1</mn>", "series_id"), "value")[0] == 9
    with pytest.raises(ValueError):
        jo.parse_formula("<mi>x</mi><mo>%</mo><mi>y</mi>")


def test_numerics():
    import numpy as np

    rng = np.random.default_rng(0)
    x = np.column_stack([np.ones(2000), rng.uniform(0, 1, 2000)])
    y = x @ [1, 2] + rng.normal(0, 0.1, 2000)
    for q in (0.1, 0.5, 0.9):
        assert abs(np.mean(y < x @ quantile_regression(x, y, q)) - q) < 0.02
    assert nonnegative_least_squares(x, -y, np.array([False, True]))[1] == 0
    assert np.allclose(recursive_least_squares(x, y, 1.0)[-1], np.linalg.lstsq(x, y, rcond=None)[0], atol=1e-2)


@given(st.integers(0, 1 << 20))
def test_gray_round_trip(k):
    assert ungray(gray(k)) == k


def test_genetic_search():
    s = [Setting("a", "discrete", levels=("mean", "max", "min")), Setting("b", "integer", 3, 20), Setting("c", "float", 30, 60, 36)]
    assert decode(encode({"a": "min", "b": 20, "c": 60.0}, s), s) == {"a": "min", "b": 20, "c": 60.0}
    f = lambda x: {"min": 0, "mean": 5, "max": 9}[x["a"]] - x["b"] - x["c"] / 10
    best, score = optimise(f, s, generations=60, patience=60)
    assert best == {"a": "min", "b": 20, "c": 60.0} and score == -26
    assert math.isnan(optimise(lambda x: float("nan"), s, generations=2)[1])
