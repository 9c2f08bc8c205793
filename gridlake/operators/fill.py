"""Filling gaps of series, and integrating meter readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.period import seconds
from gridlake.operators.blocks import carry, in_blocks, inside
from gridlake.runtime import require


def fill_series(df: DataFrame, keys: list[str], method: str = "linear", max_gap: str | None = None, masks: list[str] | None = None, only: str | None = None, time: str = "time", value: str = "value", model: str | None = None) -> DataFrame:
    """Fill NULL values: 'forward' (the value before), 'backward' (the next), 'linear' (by row, ends extended), 'model' (column ``model``).

    Rows marked by a column of ``masks`` are emptied first; with ``only`` just its TRUE rows are
    filled. A gap whose known ends are over ``max_gap`` apart, or that has one end only, is left
    when ``max_gap`` is given. Values that are there are kept.
    """
    require(df, time, value, *keys, *(masks or []), *([only] if only else []), *([model] if model else []))
    bad = F.lit(False)
    for m in masks or []:
        bad = bad | F.coalesce(F.col(m), F.lit(False))
    v = F.when(~bad & ~F.isnan(F.col(value).cast("double")), F.col(value).cast("double"))
    rows = in_blocks(df, keys, time).withColumns({"_v": v, "_t": F.unix_micros(F.col(time).cast("timestamp"))})
    rows = carry(rows, sums={"_before": F.count("*")}).withColumn("_r", F.row_number().over(inside(time)) + F.col("_before"))
    rows = rows.withColumn("_k", F.when(F.col("_v").isNotNull(), F.struct("_r", "_v", "_t")))
    rows = carry(rows, before={"_kp": F.max("_k")}, after={"_kn": F.min("_k")})
    upto = lambda back: inside(time, back).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_kp": F.coalesce(F.last("_k", True).over(upto(False)), "_kp"), "_kn": F.coalesce(F.last("_k", True).over(upto(True)), "_kn")})
    rows = rows.select(*df.columns, "_v", "_r", *[F.col(f"_k{side}._{c}").alias(n) for side in "pn" for c, n in (("v", "_" + side), ("r", f"_{side}r"), ("t", f"_{side}t"))])
    line = F.when(F.col("_nr") > F.col("_pr"), F.col("_p") + (F.col("_n") - F.col("_p")) * (F.col("_r") - F.col("_pr")) / (F.col("_nr") - F.col("_pr")))
    new = {"forward": F.col("_p"), "backward": F.col("_n"), "linear": F.coalesce(line, "_p", "_n"), "model": F.col(model) if model else F.lit(None)}[method]
    allowed = F.lit(True) if max_gap is None else F.coalesce(F.col("_nt") - F.col("_pt") <= seconds(max_gap) * 1_000_000, F.lit(False))
    if only:
        allowed = allowed & F.coalesce(F.col(only), F.lit(False))
    return rows.withColumn(value, F.coalesce("_v", F.when(allowed, new))).select(*df.columns)


def round_up(c: Column) -> Column:
    """The next power of ten; powers of ten stay, 0 gives 0."""
    return F.when(c == 0, 0.0).when(c > 0, F.pow(F.lit(10.0), F.ceil(F.round(F.log10(c), 12))))


def integrate_readings(df: DataFrame, keys: list[str], kind: str, time: str = "time", value: str = "value") -> DataFrame:
    """Readings to consumption until the next one: 'onChange' (the next value), 'cumulative' (the difference, over a counter's end), else unchanged.

    A series' last row gets NULL.
    """
    require(df, time, value, *keys)
    if kind not in ("onChange", "cumulative"):
        return df
    rows = with_next(df, keys, [value], time)
    nxt = F.col("_next")[value]
    d = nxt - F.col(value)
    return rows.withColumn(value, nxt if kind == "onChange" else F.when(d < 0, round_up(F.col(value)) - F.col(value) + nxt).otherwise(d)).select(*df.columns)


def with_next(df: DataFrame, keys: list[str], columns: list[str], time: str = "time") -> DataFrame:
    """Add ``_next``, a struct of the columns in the series' next row, NULL at its end."""
    here = F.struct(*columns)
    rows = carry(in_blocks(df, keys, time), after={"_first": F.min_by(here, F.struct(F.col(time), here))})
    return rows.withColumn("_next", F.coalesce(F.lead(here).over(inside(time)), "_first")).select(*df.columns, "_next")


def gap_islands(df: DataFrame, keys: list[str], most: str, time: str = "time") -> DataFrame:
    """Add ``island``: numbers the stretches of a series without a gap over ``most``, from 0."""
    require(df, time, *keys)
    t = F.unix_micros(F.col(time).cast("timestamp"))
    rows = carry(in_blocks(df, keys, time), before={"_last": F.max(t)})
    gap = t - F.coalesce(F.lag(t).over(inside(time)), "_last")
    rows = rows.withColumn("_new", F.coalesce(gap > seconds(most) * 1_000_000, F.lit(False)).cast("int"))
    rows = carry(rows, sums={"_before": F.sum("_new")})
    return rows.withColumn("island", F.sum("_new").over(inside(time).rowsBetween(Window.unboundedPreceding, 0)) + F.col("_before")).select(*df.columns, "island")
