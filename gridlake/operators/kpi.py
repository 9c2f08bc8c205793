"""Energy indicators over calendar periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.period import Period, bucket, bucket_seconds, iso_z, seconds
from gridlake.runtime import is_finite, require


def indicator(name: str, consumption: Column, baseline: Column | None = None, area: Column | None = None, factor: Column | None = None, degrees: Column | None = None) -> Column:
    """Value of an indicator per row; NULL where an input is missing or a denominator is 0.

    EnergyUse, EnergyUseIntensity, EnergyUseSavings, EnergyUseSavingsRelative (percent of the use),
    EnergyUseSavingsIntensity, the same of Emissions (times ``factor``), HeatingDegreeDays and
    CoolingDegreeDays (0 up to three degrees).
    """
    if name.endswith("DegreeDays"):
        return F.when(degrees > 3, degrees).when(degrees.isNotNull(), 0.0)
    scale = F.lit(1.0)
    kind = name.removeprefix("EnergyUse")
    if name.startswith("EnergyEmissions"):
        if factor is None:
            return F.lit(None).cast("double")
        scale, kind = factor, name.removeprefix("EnergyEmissions")
    saved = (baseline - consumption) * scale if baseline is not None else F.lit(None).cast("double")
    over = lambda x: F.try_divide(x, area) if area is not None else F.lit(None).cast("double")
    return {
        "": consumption * scale,
        "Intensity": over(consumption * scale),
        "Savings": saved,
        "SavingsRelative": F.try_divide(saved * 100, consumption * scale),
        "SavingsIntensity": over(saved),
    }[kind]


def longitudinal_indicators(df: DataFrame, keys: list[str], indicators: dict[str, Column], periods: list[str], step: str = "PT1H", tz: str = "UTC", min_share: float = 0.75, time: str = "time", modelled: bool = True) -> DataFrame:
    """(keys..., indicator, frequency, start, end, value, isReal, id): indicators summed over each period.

    A bucket is kept with more than ``min_share`` of its expected rows; the value is the mean times
    the expected rows. isReal: all rows are there (NULL without a model). All indicators and periods
    come from one aggregation per period over one scan.
    """
    require(df, time, *keys)
    rows = df.select(*keys, F.col(time).cast("timestamp").alias("_t"), F.inline(F.array(*[F.struct(F.lit(n).alias("indicator"), c.cast("double").alias("_v")) for n, c in indicators.items()])))
    starts = F.array(*[F.struct(F.lit(p).alias("frequency"), bucket(F.col("_t"), p, tz).alias("start")) for p in periods])
    rows = rows.where(is_finite(F.col("_v"))).select(*keys, "indicator", "_v", F.inline(starts))
    n, end = F.lit(None).cast("double"), F.lit(None).cast("timestamp")
    for p in periods:
        local = F.from_utc_timestamp("start", tz)
        n = F.when(F.col("frequency") == p, bucket_seconds(local, p) / seconds(step)).otherwise(n)
        end = F.when(F.col("frequency") == p, F.to_utc_timestamp(local + Period.parse(p).interval(), tz) - F.expr("INTERVAL 1 SECOND")).otherwise(end)
    got = rows.groupBy(*keys, "indicator", "frequency", "start").agg(F.avg("_v").alias("_m"), F.count("*").alias("_k")).withColumn("_n", n).where(F.col("_k") > F.col("_n") * min_share)
    value = F.col("_m") * F.col("_n")
    ident = F.sha2(F.concat_ws("~", *[F.col(k).cast("string") for k in keys], "indicator", "frequency"), 256)
    return got.select(*keys, "indicator", "frequency", iso_z(F.col("start")).alias("start"), iso_z(end).alias("end"), value.alias("value"), (F.lit(modelled) if not modelled else F.col("_k") == F.col("_n")).alias("isReal") if modelled else F.lit(None).cast("boolean").alias("isReal"), ident.alias("id"))


def allocate(df: DataFrame, keys: list[str], weight: Column, value: str) -> DataFrame:
    """df with ``share``, the row's weight over its group's, and ``allocated``, that part of ``value``; equal shares where the weights have no finite positive sum."""
    require(df, value, *keys)
    w = Window.partitionBy(*keys)
    rows = df.withColumn("_w", weight.cast("double"))
    total = F.sum("_w").over(w)
    good = is_finite(total) & (total > 0) & (F.count("_w").over(w) == F.count(F.lit(1)).over(w))
    share = F.when(good, F.col("_w") / F.when(good, total)).otherwise(1 / F.count(F.lit(1)).over(w))
    return rows.withColumn("share", share).withColumn("allocated", F.col(value) * F.col("share")).drop("_w")


def indicator_triples(rows: DataFrame, keys: list[str], ns: str) -> DataFrame:
    """Triples of longitudinal_indicators(): each series a subject by its id, with its indicator, frequency and keys."""
    from gridlake.operators.graph import SCHEMA, add_item

    none = rows.sparkSession.createDataFrame([], SCHEMA)
    one = rows.select("id", "indicator", "frequency", *keys).distinct().withColumn("id", F.concat(F.lit(ns), "id"))
    return add_item(none, one, "id", [ns + "KeyPerformanceIndicatorAssessment"], {ns + c: c for c in ("indicator", "frequency", *keys)}, {})
