"""Queries of day features, sentences and allocation, each beside its SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import features as fe
from gridlake.operators import kpi as kp
from gridlake.operators import outliers as ou
from gridlake.operators import profiles as pf
from gridlake.operators.sentences import transform_sentences
from gridlake.plans.catalogue import HOURS, K, hours, query, r, table
from gridlake.plans.models import S, readings

_LOCAL = f"{HOURS}, l AS (SELECT series_id, timezone('Europe/Madrid', timezone('UTC', time)) AS t, time, value, n::DOUBLE AS w FROM h), x AS (SELECT series_id, t::DATE AS date, hour(t) AS h, arg_min(value, time) AS v, arg_min(w, time) AS w FROM l GROUP BY ALL)"
_PARTS = ", ".join(f"avg(CASE WHEN h // 6 = {k} THEN v END) AS q{k}" for k in range(4))
_SUM = " + ".join(f"coalesce(q{k}, 0)" for k in range(4))
_DAYS = f"{_LOCAL}, d AS (SELECT series_id, date, avg(v) * 24 AS c, min(v) AS lo, max(v) AS hi, avg(w) AS t, {_PARTS} FROM x GROUP BY ALL)"


def _features(spark, d):
    return pf.day_features(hours(spark, d).withColumnRenamed("n", "w"), K, "Europe/Madrid", 4, bases=[3.0], holidays=["2024-01-01"], temperature="w")


@query(f"""WITH {_DAYS} SELECT series_id, strftime(date, '%Y-%m-%d') AS date, isodow(date) AS weekday, isodow(date) >= 6 AS "isWeekend", date = DATE '2024-01-01' AS "isHolidays", month(date) AS month, {r('c', 'consumption')}, {r('lo', '"minConsumption"')}, {r('hi', '"maxConsumption"')}, {r('t', 'temperature')},
{', '.join(r(f'q{k} / ({_SUM})', f'part_0{k}') for k in range(4))}, {r('greatest(1 - t, 0)', 'hdd3')}, {r('greatest(t - 5, 0)', 'cdd3')} FROM d""")
def day_features(spark, d):
    return _features(spark, d)


_SCALED = ", ".join(r(f"(({e}) - min({e}) OVER w) / (max({e}) OVER w - min({e}) OVER w)", n) for e, n in (("c", "consumption"), ("t", "temperature"), ("coalesce(q0, avg(q0) OVER w)", "part_00")) if n != "part_00")


@query(f"WITH {_DAYS} SELECT series_id, strftime(date, '%Y-%m-%d') AS date, {_SCALED} FROM d WINDOW w AS (PARTITION BY series_id)")
def feature_range(spark, d):
    return pf.scale_features(_features(spark, d), K, ["consumption", "temperature"])[0]


@query(f"WITH {_DAYS} SELECT series_id, strftime(date, '%Y-%m-%d') AS date, {r('(c - avg(c) OVER w) / stddev_samp(c) OVER w', 'consumption')} FROM d WINDOW w AS (PARTITION BY series_id)")
def feature_zscore(spark, d):
    return pf.scale_features(_features(spark, d), K, ["consumption"], "znorm")[0]


@query()
def day_signatures(spark, d):
    return pf.day_signatures(pf.day_features(readings(spark, d), S, "Europe/Madrid"), S)


@query()
def clustering_features(spark, d):
    """Days by their course, level and temperature, per sensor; the centres classify later days."""
    inputs = ["consumption", "temperature", *[f"part_{k:02d}" for k in range(8)]]
    scaled, _ = pf.scale_features(pf.day_features(readings(spark, d), S, "Europe/Madrid", 8), S, inputs)
    return pf.cluster_features(scaled, "sensorid", inputs)[0].select("sensorid", "date", "cluster")


@query()
def clustering_centres(spark, d):
    inputs = ["consumption", *[f"part_{k:02d}" for k in range(8)]]
    scaled, _ = pf.scale_features(pf.day_features(readings(spark, d), S, "Europe/Madrid", 8), S, inputs)
    return pf.cluster_features(scaled, "sensorid", inputs)[1]


@query()
def outlier_calendar_windows(spark, d):
    """Windows told apart by a column, copied days and one bad day."""
    rows = hours(spark, d).withColumn("half", F.weekday("time") >= 5)
    return ou.calendar_model_outliers(rows, K, ("H",), window_columns=["half"], bad_days=["2024-01-10"], profiled=True)


@query(f"""WITH {HOURS} SELECT series_id, epoch(time)::BIGINT AS time, {r('value * 2 + n', 'load')}, {r('sin(2 * pi() * hour(time) / 24)', 'day_sin_1')}, {r('cos(2 * pi() * hour(time) / 24)', 'day_cos_1')}, 1.0::DOUBLE AS day_fs_int, {r('coalesce(lag(value * 2 + n) OVER w, 0)', 'past_l1')},
{r('greatest(4 - n, 0)', 'cold')}, (n = 2)::INT::DOUBLE AS few_2, (n = 3)::INT::DOUBLE AS few_3 FROM h WINDOW w AS (PARTITION BY series_id ORDER BY time)""")
def sentences(spark, d):
    rows = hours(spark, d).withColumn("turn", F.hour("time") / 24)
    made, _ = transform_sentences(rows, {"load": "value * 2 + n", "day": "fourier(turn, 1)", "past": "lags(load, 1)", "cold": "heating(n, 4)", "few": "dummies(n, 2, 3)"}, K)
    return made.drop("turn", "value", "n").withColumn("past_l1", F.coalesce("past_l1", F.lit(0.0)))


@query(f"WITH w AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS v, CASE WHEN l_orderkey % 3 > 0 THEN l_quantity * l_discount END AS w FROM lineitem), s AS (SELECT *, CASE WHEN count(w) OVER o = count(*) OVER o AND sum(w) OVER o > 0 THEN w / sum(w) OVER o ELSE 1.0 / count(*) OVER o END AS share FROM w WINDOW o AS (PARTITION BY l_orderkey)) SELECT l_orderkey, l_linenumber, {r('share', 'share')}, {r('v * share', 'allocated', 4)} FROM s", digits=6)
def allocation(spark, d):
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_discount")
    got = kp.allocate(rows, ["l_orderkey"], F.when(F.col("l_orderkey") % 3 > 0, F.col("l_quantity") * F.col("l_discount")), "l_extendedprice")
    return got.select("l_orderkey", "l_linenumber", "share", (F.round(F.col("allocated") + 1.3e-8, 4)).alias("allocated"))


@query(f"WITH e AS (SELECT event_id, user_id::DOUBLE AS u FROM events), x AS (SELECT event_id, (u - min(u) OVER ()) / (max(u) OVER () - min(u) OVER ()) AS x FROM e) SELECT event_id, {r('sin(2 * pi() * x)', 'u_sin_1')}, {r('cos(2 * pi() * x)', 'u_cos_1')}, 1.0::DOUBLE AS u_fs_int FROM x")
def fourier_ranged(spark, d):
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("u"))
    return fe.fourier_components(e, ["u"], 1, ranged=True)[0].drop("u")


@query(f"WITH {HOURS}, k AS (SELECT DISTINCT series_id, unnest(['P1D', 'P1M']) AS f FROM h) SELECT p, o, count(*) AS n FROM (SELECT unnest(['type', 'indicator', 'frequency', 'series_id']) AS p, unnest(['x:KeyPerformanceIndicatorAssessment', 'EnergyUse', f, series_id]) AS o FROM k) GROUP BY ALL")
def indicator_triples(spark, d):
    rows = kp.longitudinal_indicators(hours(spark, d), K, {"EnergyUse": F.col("value")}, ["P1D", "P1M"], min_share=0.0)
    got = kp.indicator_triples(rows, K, "x:")
    return got.groupBy(F.regexp_extract("p", r"([^#:/]*)$", 1).alias("p"), "o").agg(F.count("*").alias("n"))


_FAR = "sqrt((coalesce({a}0 - c.q0, 0)) ** 2 + (coalesce({a}1 - c.q1, 0)) ** 2 + (coalesce({a}2 - c.q2, 0)) ** 2 + (coalesce({a}3 - c.q3, 0)) ** 2)"


@query(f"""WITH {_DAYS}, s AS (SELECT series_id, date, CASE WHEN day(date) % 10 > 0 THEN c END AS c, {', '.join(f'q{k} / ({_SUM}) AS q{k}' for k in range(4))} FROM d WHERE series_id = 'purchase'), w AS (SELECT *, CASE WHEN isodow(date) >= 6 THEN 'off' ELSE 'on' END AS kind FROM s),
f AS (SELECT kind, avg(c) AS c FROM w GROUP BY 1), g AS (SELECT kind, avg(q0) AS q0, avg(q1) AS q1, avg(q2) AS q2, avg(q3) AS q3 FROM w GROUP BY 1), a AS (SELECT date, arg_min(f.kind, (abs(w.c - f.c), f.kind)) AS k FROM w, f WHERE w.c IS NOT NULL GROUP BY 1),
b AS (SELECT date, arg_min(c.kind, ({_FAR.format(a='w.q')}, c.kind)) AS k FROM w, g c GROUP BY 1) SELECT strftime(w.date, '%Y-%m-%d') AS date, w.c IS NULL AS abnormal, CASE WHEN w.c IS NULL THEN b.k ELSE a.k END AS kind FROM w LEFT JOIN a USING (date) LEFT JOIN b USING (date)""")
def day_votes(spark, d):
    parts = [f"part_{k:02d}" for k in range(4)]
    days = _features(spark, d).where("series_id = 'purchase'").withColumn("consumption", F.when(F.dayofmonth("date") % 10 > 0, F.col("consumption"))).select("date", "isWeekend", "consumption", *parts)
    kinds = days.withColumn("kind", F.when(F.col("isWeekend"), "off").otherwise("on"))
    centres = lambda cs: kinds.groupBy("kind").agg(*[F.avg(c).alias(c) for c in cs])
    return pf.vote_days(days, centres(["consumption"]), ["consumption"], centres(parts), parts, "kind", most_missing=0).select("date", "abnormal", "kind")
