"""Irregular readings to a regular grid by their validity intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridlake.runtime import is_finite, require


def regular_grid(
    df: DataFrame,
    source: str = "series_id",
    time_us: str = "utc_us",
    value: str = "c1",
    step_us: int = 3_600_000_000,
    hold_us: int = 3_600_000_000,
    chunk_us: int = 86_400_000_000,
) -> DataFrame:
    """One row per source and grid cell from its first to its last usable reading.

    A reading is usable if its source and time are known and its value is a finite number. Readings
    become a step function: each is valid until the next one, firmly so for at most ``hold_us``.
    The intervals are cut at the grid lines; a cell gets ``value``, the time-weighted mean of the
    step function over the part of the cell it covers, ``coverage``, the fraction covered by firm
    validity, ``readings``, the number of usable readings in it, and ``mark``: 'observed' with
    readings, else 'filled' (the value held over a gap). Repeated readings of one instant count as
    one with their mean value, and as so many readings. A source without usable readings gives no
    rows; an empty table gives none. Extra columns are ignored.

    Readings are ordered per source and ``chunk_us`` of time, so a source with a third of all rows
    is spread over many tasks; only one row per chunk is ordered per source.
    """
    require(df, source, time_us, value)
    pts = (
        df.where(F.col(source).isNotNull() & F.col(time_us).isNotNull() & is_finite(F.col(value).cast("double")))
        .select(F.col(source).alias("_s"), F.col(time_us).alias("_t"), F.col(value).cast("double").alias("_v"))
        .groupBy("_s", "_t").agg(F.avg("_v").alias("_v"), F.count("*").alias("_n"))
        .withColumn("_c", F.floor(F.col("_t") / chunk_us))
    )
    firsts = pts.groupBy("_s", "_c").agg(F.min("_t").alias("_first"))
    after = firsts.select("_s", "_c", F.lead("_first").over(Window.partitionBy("_s").orderBy("_c")).alias("_next"))
    inner = pts.withColumn("_lead", F.lead("_t").over(Window.partitionBy("_s", "_c").orderBy("_t")))
    spans = inner.join(after, ["_s", "_c"]).withColumn("_end", F.coalesce("_lead", "_next", F.col("_t") + 1))
    cell = lambda t: F.floor(t / step_us)
    cells = spans.withColumn("_cell", F.explode(F.sequence(cell(F.col("_t")), cell(F.col("_end") - 1))))
    lo = F.greatest("_t", F.col("_cell") * step_us)
    width = (F.least("_end", (F.col("_cell") + 1) * step_us) - lo).cast("double")
    firm = F.greatest(F.lit(0), F.least("_end", (F.col("_cell") + 1) * step_us, F.col("_t") + hold_us) - lo)
    return (
        cells.groupBy("_s", "_cell")
        .agg(
            (F.sum(F.col("_v") * width) / F.sum(width)).alias("value"),
            (F.sum(firm) / F.lit(float(step_us))).alias("coverage"),
            F.sum(F.when(cell(F.col("_t")) == F.col("_cell"), F.col("_n")).otherwise(0)).alias("readings"),
        )
        .select(
            F.col("_s").alias(source),
            (F.col("_cell") * step_us).alias("slot_us"),
            "value",
            "coverage",
            "readings",
            F.when(F.col("readings") > 0, "observed").otherwise("filled").alias("mark"),
        )
    )
