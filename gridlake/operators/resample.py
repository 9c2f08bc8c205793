"""Time steps, resampling and alignment to a time grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.period import bucket, bucket_seconds, iso_of_seconds, seconds
from gridlake.operators.blocks import carry, in_blocks, inside
from gridlake.operators.features import degree_raw
from gridlake.runtime import is_finite, require


def detect_time_step(df: DataFrame, keys: list[str], time: str = "time") -> DataFrame:
    """(keys..., timestep): each series' most frequent difference as an ISO period; ties go to the alphabetically first.

    Series with fewer than two times have NULL. NULL times don't count; repeated times count with a
    step of zero seconds.
    """
    require(df, time, *keys)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    rows = carry(in_blocks(df.where(F.col(time).isNotNull()).select(*keys, time), keys, time), before={"_last": F.max(us)})
    steps = rows.select(*keys, (us - F.coalesce(F.lag(us).over(inside(time)), "_last")).alias("_d"))
    counted = steps.where("_d IS NOT NULL").select(*keys, iso_of_seconds(F.floor(F.col("_d") / 1_000_000)).alias("_iso")).groupBy(*keys, "_iso").agg(F.count("*").alias("_n"))
    best = counted.groupBy(*keys).agg(F.min_by("_iso", F.struct((-F.col("_n")).alias("n"), "_iso")).alias("timestep"))
    names = df.select(*keys).distinct()
    same = [names[k].eqNullSafe(best[k]) for k in keys]
    return names.join(best, same, "left").select(*[names[k] for k in keys], "timestep")


def resample_and_aggregate(
    df: DataFrame, keys: list[str], timestep: str, func: str = "SUM", time: str = "time", value: str = "value", weight: str | None = None, min_ratio: float = 0.0, expected: Column | None = None, step: str = "PT1H", estimate: bool = True, tz: str = "UTC"
) -> DataFrame:
    """(keys..., time, value, isReal, count) per bucket of ``timestep``.

    SUM: the mean times the expected count (``estimate``) or the plain sum; AVG; WEIGHTED-AVG by
    ``weight`` over the rows with a value. A bucket is kept if more than ``min_ratio`` percent of the
    expected rows are there (rows without a value count). isReal: all expected rows are there; NULL
    without a finite value. ``timestep`` '' takes each series' first 365 days as one bucket.
    """
    require(df, time, value, *keys, *([weight] if weight else []))
    if func not in ("SUM", "AVG", "WEIGHTED-AVG"):
        raise ValueError(f"func is {func}, not SUM, AVG or WEIGHTED-AVG")
    t, v = F.col(time).cast("timestamp"), F.when(is_finite(F.col(value).cast("double")), F.col(value).cast("double"))
    if timestep == "":
        first = F.min(t).over(Window.partitionBy(*keys))
        rows = df.withColumn("_b", first).where(t < F.col("_b") + F.expr("INTERVAL 365 DAYS"))
        n = F.count("*").cast("double")
    else:
        if seconds(timestep) < seconds(step):
            raise ValueError("timestep is shorter than the step of the data")
        rows = df.withColumn("_b", bucket(t, timestep, tz))
        n = F.max(expected if expected is not None else bucket_seconds(F.col("_b"), timestep) / seconds(step))
    total = {
        "SUM": F.avg(v) * n if estimate else F.sum(v),
        "AVG": F.avg(v),
        "WEIGHTED-AVG": F.try_divide(F.sum(v * F.col(weight)), F.sum(F.when(v.isNotNull(), F.col(weight)))) if weight else F.avg(v),
    }[func]
    got = rows.groupBy(*keys, F.col("_b").alias("time")).agg(total.alias("value"), F.count("*").alias("count"), n.alias("_n"))
    kept = got.where(F.col("count") > F.col("_n") * min_ratio / 100)
    return kept.select(*keys, "time", "value", F.when(is_finite(F.col("value")), F.col("count") == F.col("_n")).alias("isReal"), "count")


def align_time_grid(
    df: DataFrame, keys: list[str], output: str, functions: list[str], step: str, time: str = "time", value: str = "value", is_real: str | None = "isReal", suffix: str = "", use_estimated: bool = False, tz: str = "UTC", bases: tuple[int, ...] = (20, 21, 22)
) -> DataFrame:
    """(keys..., time, SUM/AVG/MIN/MAX.../HDDb/CDDb, GAPS, RATIO) on a grid of ``output``.

    Without ``use_estimated`` only rows with isReal TRUE are used. GAPS is the share of rows without
    value, RATIO the share of the bucket's length that the rows with value fill. If the data's step
    is not shorter than ``output``, rows pass through. HDD and CDD are sums over daily means.
    """
    require(df, time, value, *keys)
    if is_real and is_real in df.columns and not use_estimated:
        df = df.where(F.coalesce(F.col(is_real), F.lit(False)))
    t, v = F.col(time).cast("timestamp"), F.when(~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    plain = {"SUM": F.sum(v), "AVG": F.avg(v), "MIN": F.min(v), "MAX": F.max(v)}
    name = lambda f: f + (f"_{suffix}" if suffix else "")
    if seconds(step) >= seconds(output):
        return df.select(*keys, t.alias("time"), *[v.alias(name(f)) for f in functions if f in plain], F.lit(0.0).alias("GAPS"), F.lit(1.0).alias("RATIO"))
    b = bucket(t, output, tz)
    known = F.count(v).cast("double")
    aggs = [F.coalesce(plain[f], F.lit(0.0)).alias(name(f)) if f == "SUM" else plain[f].alias(name(f)) for f in functions if f in plain]
    out = df.groupBy(*keys, b.alias("time")).agg(*aggs, (1 - known / F.count("*")).alias("GAPS"), (known * seconds(step)).alias("_s"))
    out = out.withColumn("RATIO", F.col("_s") / bucket_seconds(F.from_utc_timestamp("time", tz), output)).drop("_s")
    modes = [m for m in ("HDD", "CDD") if m in functions]
    if modes:
        days = df.groupBy(*keys, bucket(t, "P1D", tz).alias("_day")).agg(F.avg(v).alias("_v"))
        dd = days.groupBy(*keys, bucket(F.col("_day"), output, tz).alias("time")).agg(*[
            F.sum(degree_raw(F.col("_v"), F.lit(float(x)), "heating" if m == "HDD" else "cooling", hysteresis=0.0)).alias(name(f"{m}{x}")) for m in modes for x in bases
        ])
        out = out.join(dd, [*keys, "time"])
    return out


def pad_grid(df: DataFrame, keys: list[str], step: str, time: str = "time") -> DataFrame:
    """All rows, and one row with NULLs for each time of the grid between a series' first and last that has none."""
    require(df, time, *keys)
    ends = df.groupBy(*keys).agg(F.min(F.col(time).cast("timestamp")).alias("_a"), F.max(F.col(time).cast("timestamp")).alias("_z")).where("_a IS NOT NULL")
    grid = ends.select(*keys, F.explode(F.sequence("_a", "_z", F.make_dt_interval(secs=F.lit(seconds(step))))).alias(time))
    return grid.join(df.withColumn(time, F.col(time).cast("timestamp")), [*keys, time], "full")
