"""Queries of the trainable operators. Only the metrics have SQL."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.operators import models as m
from gridlake.operators import profiles as pf
from gridlake.operators.features import lag_components
from gridlake.operators.missing import PLACEHOLDER_NUMBERS, no_number
from gridlake.operators.tuning import Setting, optimise
from gridlake.plans.catalogue import HOURS, K, hours, query, r, table


def readings(spark, d) -> DataFrame:
    """Readings with a measured consumption and temperature, and model terms."""
    b = table(spark, d, "building_hourly").where(~no_number(F.col("qe")) & ~no_number(F.col("temperature")) & (F.col("qe") >= 0) & F.abs("temperature").between(0, 60))
    one = b.groupBy("sensorid", F.col("reading_ts").alias("time")).agg(F.min(F.struct("reading_id", "qe", "temperature")).alias("m")).select("sensorid", "time", F.col("m.qe").alias("value"), F.col("m.temperature").alias("temperature"))
    t = F.col("temperature")
    return one.select("*", F.lit(1.0).alias("one"), F.greatest(16 - t, F.lit(0.0)).alias("heat"), F.greatest(t - 24, F.lit(0.0)).alias("cool"), F.hour("time").cast("string").alias("hour"))


S = ["sensorid"]
TERMS = [m.Feature("one", expr="one"), m.Feature("heat", expr="heat"), m.Feature("cool", expr="cool"), m.Feature("hour", categories="hour")]


_ONE = f"x AS (SELECT sensorid, arg_min(qe, reading_id)::DOUBLE AS y, arg_min(temperature, reading_id)::DOUBLE AS t FROM building_hourly WHERE {{}} GROUP BY sensorid, reading_ts)".format(
    " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND {c} NOT IN ({', '.join(f'{x}::DOUBLE' for x in PLACEHOLDER_NUMBERS)})" for c in ("qe", "temperature")) + " AND qe >= 0 AND temperature BETWEEN -60 AND 60 AND abs(temperature) BETWEEN 0 AND 60"
)


@query(f"WITH {HOURS}, l AS (SELECT series_id, value, lag(value) OVER (PARTITION BY series_id ORDER BY time) AS p FROM h) SELECT series_id, {r('-sqrt(avg(pow(value - p, 2))) / avg(value)', '\"CVRMSE\"')}, {r('-sqrt(avg(pow(value - p, 2)))', '\"RMSE\"')}, {r('pow(corr(value, p), 2)', '\"R2\"')} FROM l WHERE p IS NOT NULL GROUP BY 1")
def regression_metrics(spark, d):
    return m.regression_metrics(lag_components(hours(spark, d), K, ["value"], [1]), "value", "value_l1", K)


@query()
def glm_gaussian(spark, d):
    x = readings(spark, d)
    return m.regression_metrics(m.predict(m.fit_linear(x, TERMS, "value"), x, low=0.0), "value", "predicted", S)


@query(f"WITH {_ONE}, b AS (SELECT regr_slope(y, t) AS s, regr_intercept(y, t) AS a FROM x) SELECT sensorid, round(-sqrt(avg(pow(y - a - s * t, 2))) + 1.3e-8, 3) + 0.0 AS \"RMSE\" FROM x, b GROUP BY 1", digits=3)
def glm_line(spark, d):
    x = readings(spark, d)
    return m.regression_metrics(m.predict(m.fit_linear(x, [m.Feature("t", expr="temperature")], "value"), x), "value", "predicted", S).select("sensorid", "RMSE")


@query()
def glm_gamma(spark, d):
    x = readings(spark, d).where("value > 0")
    return m.regression_metrics(m.predict(m.fit_linear(x, TERMS, "value", "gamma", "log"), x), "value", "predicted", S)


@query()
def random_forest(spark, d):
    x = readings(spark, d)
    return m.regression_metrics(m.predict(m.fit_forest(x, [m.Feature("t", expr="temperature"), m.Feature("h", expr="CAST(hour AS INT)"), m.Feature("d", expr="weekday(time)"), m.Feature("heat", expr="heat"), m.Feature("cool", expr="cool")], "value"), x), "value", "predicted", S)




@query(f"WITH {_ONE} SELECT sensorid, unnest(['one', 'temperature']) AS term, round(unnest([regr_intercept(y, t), regr_slope(y, t)]), 3) + 0.0 AS coefficient FROM x GROUP BY 1 HAVING regr_slope(y, t) IS NOT NULL", digits=3)
def linear_coefficients(spark, d):
    got = m.penalised_linear(readings(spark, d), S, ["one", "temperature"], "value")
    several = readings(spark, d).groupBy(*S).agg((F.var_pop("temperature") > 0).alias("varies")).where("varies").select(*S)
    return got.join(several, S)


_TUNE = f"""{HOURS}, n AS (SELECT series_id, value AS y, hour(time) AS hr, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS c FROM h), f AS (SELECT *, unnest(range(0, ((c - 288) // 120 + 1)::BIGINT)) AS fold FROM n),
p AS (SELECT *, CASE WHEN i < 240 + 120 * fold THEN 'train' WHEN i < 288 + 120 * fold THEN 'test' END AS part, unnest([6, 12, 18]) AS base FROM f), x AS (SELECT *, greatest(hr - base, 0)::DOUBLE AS x FROM p WHERE part IS NOT NULL),
b AS (SELECT series_id, fold, base, regr_slope(y, x) AS s, regr_intercept(y, x) AS a FROM x WHERE part = 'train' GROUP BY ALL), e AS (SELECT series_id, base, count(DISTINCT fold) AS folds, sqrt(avg(pow(y - a - s * x, 2))) AS rmse FROM x JOIN b USING (series_id, fold, base) WHERE part = 'test' GROUP BY ALL)"""


def _tuned(spark, d):
    terms = lambda g: {"one": F.lit(1.0), "late": F.greatest(F.hour("time") - g["base"], F.lit(0))}
    return m.tune_linear(hours(spark, d), K, m.input_grid({"base": [6, 12, 18]}), terms, "value", 240, 48, 119)


@query(f"WITH {_TUNE} SELECT series_id, '{{\"base\": ' || base || '}}' AS params, folds, {r('rmse', '\"RMSE\"', 4)} FROM e", digits=4)
def tuning_scores(spark, d):
    return _tuned(spark, d)[0]


@query(f"WITH {_TUNE} SELECT series_id, '{{\"base\": ' || arg_min(base, rmse) || '}}' AS params, {r('min(rmse)', '\"RMSE\"', 4)} FROM e GROUP BY 1", digits=4)
def tuning_best(spark, d):
    return _tuned(spark, d)[1]


@query()
def arx_boxcox(spark, d):
    return m.autoregressive(readings(spark, d).withColumn("off", F.weekday("time") >= 5), S, ["heat", "cool"], "value", [1, 24], 24, low=0.0, boxcox=0.5, status="off")


@query()
def glm_recursive(spark, d):
    lags = [1, 24]
    x = lag_components(readings(spark, d), S, ["value"], lags)
    model = m.fit_linear(x.dropna(subset=["value_l1", "value_l24"]), [*TERMS, *m.lag_terms("value", lags)], "value")
    return m.recursive_forecast(readings(spark, d), lambda df: m.predict(model, df), S, "value", lags, 6, low=0.0)


@query()
def penalised_linear(spark, d):
    return m.penalised_linear(readings(spark, d), S, ["one", "heat", "cool"], "value", ["heat", "cool"])


@query()
def arx_recursive(spark, d):
    return m.autoregressive(readings(spark, d), S, ["heat", "cool"], "value", [1, 2, 24], 24, low=0.0)


@query()
def rls_predictions(spark, d):
    x = readings(spark, d)
    c = m.recursive_coefficients(x, S, ["one", "heat", "cool"], "value", 0.995, warm_up=24)
    return m.recursive_predictions(x, c, S, ["one", "heat", "cool"], "24 HOURS", low=0.0)


@query()
def disaggregate(spark, d):
    x = readings(spark, d)
    model = m.fit_linear(x, TERMS, "value")
    return m.disaggregate(x, lambda df: m.predict(model, df, low=0.0), S, "heat", "cool", "value")


@query()
def prediction_intervals(spark, d):
    x = readings(spark, d).select("sensorid", "time", F.col("value").alias("predicted"), (F.col("value") * 0.1).alias("sigma"))
    return m.prediction_intervals(x, S, "P1D")


@query()
def occupancy(spark, d):
    w = readings(spark, d).withColumn("predicted", F.avg("value").over(Window.partitionBy("sensorid", "hour")))
    return m.occupancy(w, S, "value", "predicted")


@query()
def white_noise_test(spark, d):
    return m.white_noise_test(readings(spark, d), S, "value")


@query()
def balance_temperature(spark, d):
    x = readings(spark, d)
    model = m.fit_linear(x, TERMS, "value")
    terms = lambda df: df.withColumns({"one": F.lit(1.0), "heat": F.greatest(16 - F.col("temperature"), F.lit(0.0)), "cool": F.greatest(F.col("temperature") - 24, F.lit(0.0))})
    return m.balance_temperature(x, lambda df: m.predict(model, terms(df)), S, "temperature", ["hour"])


@query()
def change_point(spark, d):
    return pf.change_points(readings(spark, d), S, "UTC")


@query("SELECT r_regionkey::BIGINT AS r_regionkey, CASE WHEN r_regionkey < 4 THEN epoch(DATE '2023-03-05' + (r_regionkey * 9)::INT)::BIGINT ELSE -1 END AS start, CASE WHEN r_regionkey < 4 THEN epoch(DATE '2023-05-20' + (r_regionkey * 6)::INT)::BIGINT ELSE -1 END AS \"end\" FROM region")
def disruptive_period(spark, d):
    """Two years of days per region with a planted drop, which begins and ends later by region; the last region has none."""
    days = table(spark, d, "region").select("r_regionkey", F.explode(F.sequence(F.lit("2022-01-01").cast("date"), F.lit("2023-12-31").cast("date"))).alias("day"))
    n = F.dayofyear("day")
    t = 15 - 10 * F.cos(2 * math.pi * n / 365)
    start, end = F.date_add(F.lit("2023-03-05").cast("date"), F.col("r_regionkey") * 9), F.date_add(F.lit("2023-05-20").cast("date"), F.col("r_regionkey") * 6)
    drop = (F.col("day") >= start) & (F.col("day") <= end) & (F.col("r_regionkey") < 4)
    noise = (F.pmod(F.xxhash64("r_regionkey", "day"), F.lit(1000)) - 500) / 100.0
    v = (100 + 4 * F.greatest(16 - t, F.lit(0.0)) + 3 * F.greatest(t - 22, F.lit(0.0)) - F.when(F.weekday("day") >= 5, 15.0).otherwise(0.0)) * F.when(drop, 0.5).otherwise(1.0) + noise
    rows = days.select("r_regionkey", F.col("day").cast("timestamp").alias("time"), t.alias("temperature"), v.alias("value"))
    got = m.disruptive_period(rows, ["r_regionkey"], ("2023-02-15", "2023-05-01"), ("2023-05-01", "2023-07-15"), "UTC")
    return got.select("r_regionkey", *[F.coalesce(F.unix_seconds(c), F.lit(-1)).alias(c) for c in ("start", "end")])


@query(f"""WITH {HOURS}, n AS (SELECT series_id, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS i, count(*) OVER (PARTITION BY series_id) AS c FROM h), f AS (SELECT *, unnest(range(0, ((c - 124) // 24 + 1)::BIGINT)) AS fold FROM n),
p AS (SELECT series_id, fold, CASE WHEN i < 100 + 24 * fold THEN 'train' WHEN i < 124 + 24 * fold THEN 'test' END AS part FROM f) SELECT series_id, fold, part, count(*) AS n FROM p WHERE part IS NOT NULL GROUP BY ALL""")
def time_slices(spark, d):
    return m.time_slices(hours(spark, d), K, 100, 24, 23).groupBy("series_id", "fold", "part").agg(F.count("*").alias("n"))


@query()
def ga_tuning(spark, d):
    """The base temperatures whose degree terms correlate best with consumption; every fitness is one pass over grouped sums."""
    x = readings(spark, d)
    sums = x.groupBy(F.round("temperature").alias("t")).agg(F.sum("value").alias("s"), F.count("*").alias("n"), F.sum(F.col("value") ** 2).alias("q")).toPandas()  # one row per degree

    def fitness(s: dict) -> float:
        import numpy as np

        a = np.column_stack([np.ones(len(sums)), np.maximum(s["heating"] - sums.t, 0), np.maximum(sums.t - s["cooling"], 0)])
        w = sums.n.to_numpy(dtype=float)
        beta = np.linalg.lstsq((a.T * w) @ a, a.T @ sums.s.to_numpy(), rcond=None)[0]
        fit = a @ beta
        return float((sums.q - 2 * fit * sums.s + w * fit**2).sum() / w.sum())

    best, score = optimise(fitness, [Setting("heating", "integer", 10, 21), Setting("cooling", "integer", 18, 28)])
    return spark.createDataFrame([(float(best["heating"]), float(best["cooling"]), score)], "heating double, cooling double, mse double")


@query(f"""WITH {HOURS}, l AS (SELECT series_id, time, value AS y, lag(value) OVER w AS p, row_number() OVER (PARTITION BY series_id ORDER BY time DESC) AS back FROM h WINDOW w AS (PARTITION BY series_id ORDER BY time)),
b AS (SELECT series_id, regr_slope(y, p) AS s, regr_intercept(y, p) AS a, arg_max(y, time) AS y FROM l WHERE back > 3 GROUP BY 1), p AS (SELECT *, a + s * y AS p1, a + s * (a + s * y) AS p2, a + s * (a + s * (a + s * y)) AS p3 FROM b)
SELECT series_id, epoch(l.time)::BIGINT AS time, {r('CASE back WHEN 3 THEN p1 WHEN 2 THEN p2 ELSE p3 END', 'predicted', 4)} FROM l JOIN p USING (series_id) WHERE back <= 3""", digits=4)
def ar_recursive(spark, d):
    """Three steps of a model with one lag, for which SQL has the fit."""
    return m.autoregressive(hours(spark, d), K, [], "value", [1], 3)


@query(f"""WITH {HOURS}, i AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY time) - 1 AS i FROM h)
SELECT series_id, epoch(time)::BIGINT AS time, {r('sum(value * pow(0.995, -i)) OVER w / (sum(pow(0.995, -i)) OVER w + 0.995 * 1e-4)', 'one', 4)} FROM i WINDOW w AS (PARTITION BY series_id ORDER BY time)""", digits=4)
def rls_level(spark, d):
    """Recursive least squares of a constant: a mean that forgets."""
    return m.recursive_coefficients(hours(spark, d).withColumn("one", F.lit(1.0)), K, ["one"], "value", 0.995)


_SPLIT = f"""{HOURS}, x AS (SELECT series_id, time, value, greatest(12 - hour(time), 0)::DOUBLE AS heat, greatest(hour(time) - 18, 0)::DOUBLE AS cool FROM h),
s AS (SELECT series_id, time, value, avg(5.0) OVER w AS b, avg(0.8 * heat) OVER w AS h, avg(0.6 * cool) OVER w AS c FROM x WINDOW w AS (PARTITION BY series_id ORDER BY time ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING))"""


@query(f"WITH {_SPLIT} SELECT series_id, epoch(time)::BIGINT AS time, {r('b', 'baseload')}, {r('h', 'heating_part')}, {r('c', 'cooling_part')}, {r('value * b / (b + h + c)', 'baseload_real')}, {r('value * h / (b + h + c)', 'heating_real')}, {r('value * c / (b + h + c)', 'cooling_real')} FROM s")
def disaggregate_known(spark, d):
    """By a predictor of known coefficients."""
    x = hours(spark, d).select("series_id", "time", "value", F.greatest(12 - F.hour("time"), F.lit(0)).cast("double").alias("heat"), F.greatest(F.hour("time") - 18, F.lit(0)).cast("double").alias("cool"))
    got = m.disaggregate(x, lambda df: df.withColumn("predicted", 5.0 + 0.8 * F.col("heat") + 0.6 * F.col("cool")), K, "heat", "cool", "value")
    return got.drop("value", "heat", "cool")
