"""Queries of the sensor operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from gridlake.operators import sensors as se
from gridlake.plans.catalogue import HOURS, K, hours, query, r, table
from gridlake.plans.models import S, readings

_GRID = f"""WITH {HOURS}, i AS (SELECT series_id, epoch(time) AS a, epoch(time) + 5400 AS z, value AS v FROM h), k AS (SELECT *, unnest(generate_series((a // 3600)::BIGINT, ((z - 1) // 3600)::BIGINT)) AS k FROM i),
p AS (SELECT *, least(z, (k + 1) * 3600) - greatest(a, k * 3600) AS w FROM k) SELECT series_id, k * 3600 AS time, {{}}, {r('sum(w) / 3600', 'covered')} FROM p GROUP BY series_id, k"""


def _intervals(spark, d):
    return hours(spark, d).select("series_id", F.col("time").alias("start"), (F.col("time") + F.expr("INTERVAL 90 MINUTES")).alias("end"), "value")


@query(_GRID.format(r("sum(v * w / (z - a))", "value")))
def sensor_intervals_sum(spark, d):
    return se.intervals_to_grid(_intervals(spark, d), K, "PT1H", "SUM")


@query(_GRID.format(r("sum(v * w) / sum(w)", "value")))
def sensor_intervals_avg(spark, d):
    return se.intervals_to_grid(_intervals(spark, d), K, "PT1H", "AVG")


@query(f"WITH {HOURS}, l AS (SELECT *, lead(time) OVER (PARTITION BY series_id ORDER BY time) AS nt FROM h) SELECT series_id, epoch(time)::BIGINT AS start, epoch(least(coalesce(nt, time + INTERVAL 2 HOUR), time + INTERVAL 2 HOUR))::BIGINT AS \"end\", {r('value', 'value')} FROM l")
def sensor_on_change(spark, d):
    return se.interval_ends(_intervals(spark, d), K, F.lit(True), F.lit(False), "PT2H")


@query("SELECT sensorid, max(registered_ts) IS NOT NULL AS known, arg_max(timeseriesfrequency, CASE WHEN timeseriesfrequency IS NOT NULL THEN registered_ts END) AS timeseriesfrequency FROM harmonised_reading WHERE sensorid IS NOT NULL GROUP BY 1")
def sensor_metadata(spark, d):
    m = se.sensor_metadata(table(spark, d, "harmonised_reading"))
    return m.select("sensorid", F.col("registered_ts").isNotNull().alias("known"), "timeseriesfrequency")


@query("""WITH z AS (SELECT lower(name) AS spelt, min(name) AS zone FROM pg_timezone_names() WHERE name NOT IN ('Factory', 'localtime') GROUP BY 1 UNION ALL SELECT 'z', 'UTC'),
m AS (SELECT sensorid, measuredproperty, registered_ts, replace(lower(trim(regexp_replace(addresstimezone, '\\s+', ' ', 'g'))), ' ', '_') AS spelt FROM harmonised_reading WHERE sensorid IS NOT NULL)
SELECT sensorid, coalesce(min(CASE WHEN spelt IN ('utc', 'gmt') THEN 'UTC' ELSE zone END), 'UTC') AS zone, CASE WHEN regexp_matches(arg_max(measuredproperty, CASE WHEN measuredproperty IS NOT NULL THEN registered_ts END), 'Temperature|HumidityRatio|Power') THEN 'AVG' ELSE 'SUM' END AS aggregation FROM m LEFT JOIN z USING (spelt) GROUP BY 1""")
def sensor_zones(spark, d):
    return se.sensor_metadata(table(spark, d, "harmonised_reading")).select("sensorid", "zone", se.aggregation_of(F.col("measuredproperty")).alias("aggregation"))


@query()
def energy_signature(spark, d):
    return se.energy_signature(readings(spark, d), S, "UTC")


@query()
def consumption_levels(spark, d):
    from gridlake.operators.profiles import consumption_levels as levels

    return levels(readings(spark, d), S)


@query()
def classification(spark, d):
    from gridlake.operators import profiles as pf

    e = table(spark, d, "events").select(F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("time"), "value")
    m = pf.load_curve_matrix(e, K, "UTC", 4)
    parts = [c for c in m.columns if c.startswith("part_")]
    kinds = m.withColumn("kind", F.when(F.weekday("date") >= 5, "weekend").otherwise("workday"))
    centres = kinds.groupBy(F.col("kind").alias("s")).agg(*[F.avg(c).alias(c) for c in parts])
    return pf.classify_days(m, centres, parts, "s", pf.calendar_classifier(kinds, "kind"))
