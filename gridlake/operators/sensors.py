"""Sensor series and their metadata: intervals to a grid, registrations, buildings' graph facts, holidays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridlake.functions.period import seconds
from gridlake.operators.fill import round_up, with_next
from gridlake.operators.graph import match, optional
from gridlake.operators.timestamps import source_zones
from gridlake.runtime import require


def interval_ends(df: DataFrame, keys: list[str], on_change: Column, cumulative: Column, hold: str | Column, time: str = "start", end: str = "end", value: str = "value") -> DataFrame:
    """Readings as intervals with a consumption or level.

    Cumulative series: from one reading to the next, the difference over a counter's end. On-change
    series: until the next reading, at most ``hold`` (a period, or seconds by row). Others keep their ``end``. Rows without an end or
    value give none.
    """
    require(df, time, end, value, *keys)
    own, df = df.columns, with_next(df, keys, [time, value], time)
    nxt, nv = F.col("_next")[time], F.col("_next")[value]
    d = nv - F.col(value)
    grown = F.when(d < 0, round_up(F.col(value)) - F.col(value) + nv).otherwise(d)
    stop = F.when(cumulative, nxt).when(on_change, F.least(nxt, F.col(time) + F.make_dt_interval(secs=F.lit(seconds(hold)) if isinstance(hold, str) else hold))).otherwise(F.col(end))
    return df.withColumns({end: stop, value: F.when(cumulative, grown).otherwise(F.col(value))}).where(F.col(end).isNotNull() & F.col(value).isNotNull() & (F.col(end) > F.col(time))).select(*own)


def intervals_to_grid(df: DataFrame, keys: list[str], step: str, how: str, time: str = "start", end: str = "end", value: str = "value") -> DataFrame:
    """(keys..., time, value, covered) per grid cell: the share of each interval's value that falls in it (SUM), or the time-weighted mean (AVG).

    ``covered`` is the fraction of the cell under intervals, over 1 where they overlap. SUM keeps the total.
    """
    require(df, time, end, value, *keys)
    size = seconds(step) * 1_000_000
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows = df.where(F.col(end) > F.col(time)).select(*keys, us(time).alias("_a"), us(end).alias("_z"), F.col(value).cast("double").alias("_v"))
    cells = rows.withColumn("_k", F.explode(F.sequence(F.floor(F.col("_a") / size), F.floor((F.col("_z") - 1) / size))))
    part = (F.least("_z", (F.col("_k") + 1) * size) - F.greatest("_a", F.col("_k") * size)).cast("double")
    total = F.sum(F.col("_v") * part / (F.col("_z") - F.col("_a"))) if how == "SUM" else F.sum(F.col("_v") * part) / F.sum(part)
    return cells.groupBy(*keys, F.timestamp_micros(F.col("_k") * size).alias("time")).agg(total.alias("value"), (F.sum(part) / size).alias("covered"))


def sensor_metadata(df: DataFrame, sensor: str = "sensorid", zone: str = "addresstimezone", registered: str = "registered_ts") -> DataFrame:
    """One row per sensor: of several registrations each column's newest known value, and its zone under its proper name (UTC if not understood)."""
    require(df, sensor, zone, registered)
    rest = [c for c in df.columns if c not in (sensor, zone, registered)]
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(registered))).alias(c) for c in rest]
    one = df.where(F.col(sensor).isNotNull()).groupBy(sensor).agg(*newest, F.max(registered).alias(registered))
    z = source_zones(df, sensor, zone).select(F.col("source").alias(sensor), "zone")
    return one.join(z, sensor, "left").withColumn("zone", F.coalesce("zone", F.lit("UTC")))


def aggregation_of(prop: Column) -> Column:
    """AVG for levels (temperature, humidity, power), SUM for energy and all else."""
    return F.when(prop.rlike("Temperature|HumidityRatio|Power"), "AVG").otherwise("SUM")


def building_facts(triples: DataFrame, ns: str) -> DataFrame:
    """(building, space, device, sensor, tz, area): the measurement paths of the graph, with zone and area where they are stated."""
    t = lambda n: ns + n
    path = match(triples, [("?sensor", t("hasMeasurement"), "?measurement"), ("?device", t("hasSensor"), "?sensor"), ("?space", t("isObservedByDevice"), "?device"), ("?building", t("hasSpace"), "?space")])
    got = optional(path, triples, [("?building", t("hasLocationInfo"), "?location"), ("?location", t("addressTimeZone"), "?tz")])
    area = match(triples, [("?space", t("hasArea"), "?a"), ("?a", t("areaType"), "GrossFloorArea"), ("?a", t("areaValue"), "?v")]).groupBy("space").agg(F.expr("nullif(sum(try_cast(v AS DOUBLE)), 0)").alias("area"))
    return got.join(area, "space", "left").select("building", "space", "device", "sensor", F.coalesce("tz", F.lit("UTC")).alias("tz"), "area")


def holiday_table(spark: SparkSession, client: Callable[[int, str], list[dict]], years: list[int], country: str, region: str | None = None) -> DataFrame:
    """(date): public holidays from ``client(year, country)``, whose items have a date and perhaps counties.

    A holiday of named counties counts only for ``region``, written as country-region.
    """
    rows = [(h["date"],) for y in years for h in client(y, country) if not h.get("counties") or (region and f"{country}-{region}" in h["counties"])]
    return spark.createDataFrame(rows, "date string").select(F.to_date("date").alias("date")).distinct()


def energy_signature(df: DataFrame, keys: list[str], tz: str, heating_base: float = 16.0, cooling_base: float = 22.0, temperature: str = "temperature", value: str = "value", time: str = "time") -> DataFrame:
    """(keys..., date, value, temperature, baseload, heating, cooling, residual): each day's consumption split by its series' signature.

    The signature is a line of baseload plus non-negative slopes on the degrees below and above the
    bases, fitted per series from cross-products, so a series may have any number of days.
    """
    from gridlake.operators.models import penalised_linear

    day = F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), tz))
    days = df.groupBy(*keys, day.alias("date")).agg((F.avg(value) * 24).alias("value"), F.avg(temperature).alias("temperature"))
    days = days.withColumns({"_one": F.lit(1.0), "_h": F.greatest(heating_base - F.col("temperature"), F.lit(0.0)), "_c": F.greatest(F.col("temperature") - cooling_base, F.lit(0.0))})
    terms = ["_one", "_h", "_c"]
    fit = penalised_linear(days, keys, terms, "value", terms).groupBy(*keys).agg(*[F.max(F.when(F.col("term") == t, F.col("coefficient"))).alias("b" + t) for t in terms])
    parts = {"baseload": F.col("b_one"), "heating": F.col("b_h") * F.col("_h"), "cooling": F.col("b_c") * F.col("_c")}
    got = days.join(fit, keys).withColumns(parts)
    return got.select(*keys, "date", "value", "temperature", *parts, (F.col("value") - F.col("baseload") - F.col("heating") - F.col("cooling")).alias("residual"))
