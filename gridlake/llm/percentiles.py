"""Exact percentiles per group from cumulative frequencies, combinable across partitions and days."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.runtime import cut


def value_counts(df: DataFrame, groups: dict[str, Column], value: Column, missing: Column | None = None) -> DataFrame:
    """State: (groups..., value, n), how often each value occurs in each group.

    NULL, NaN and what ``missing`` marks don't count; -0.0 counts as 0.0. Counted before the shuffle,
    so a group with a third of all rows sends no more than its distinct values.
    """
    v = value.cast("double")
    ok = v.isNotNull() & ~F.isnan(v)
    ok = ok & ~missing if missing is not None else ok
    rows = df.select(*[c.alias(g) for g, c in groups.items()], F.when(ok, v + F.lit(0.0)).alias("value")).where("value IS NOT NULL")
    return rows.groupBy(*groups, "value").agg(F.count("*").alias("n"))


def merge_counts(states: DataFrame, groups: list[str]) -> DataFrame:
    """One state from the rows of several (days, files); also coarsens to fewer groups."""
    return states.groupBy(*groups, "value").agg(F.sum("n").alias("n"))


def percentiles(state: DataFrame, groups: list[str], points: list[float]) -> DataFrame:
    """(groups..., n, p05...) with linear interpolation between the two nearest ranks; no error.

    The state is range-sorted by group and value; each partition's totals per group give the
    offset of the next, so running sums within a partition become ranks. A percentile is the first
    value whose rank reaches the target. A group may span any number of partitions. A NULL group
    is a group; groups without values have no row.
    """
    spark = state.sparkSession
    key = [F.col(g) for g in groups]
    # Cut here: the partitions that ranges were sampled for must be the same ones at both uses.
    sorted_ = cut(state.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *key, F.col("value")).withColumn("_part", F.spark_partition_id()))
    totals = sorted_.groupBy("_part", *groups).agg(F.sum("n").alias("_n"))
    w = Window.partitionBy(*groups).orderBy("_part")
    offsets = totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias("_" + g) for g in groups],
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_all"),
    )
    same = F.col("_part") == F.col("_p")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col("_" + g))
    inside = Window.partitionBy("_part", *groups).orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sorted_.withColumn("_upto", F.sum("n").over(inside)).join(offsets, same).withColumn("_upto", F.col("_upto") + F.col("_before"))
    aggs = []
    for p in points:
        at = F.lit(float(p)) * (F.col("_all") - 1)
        lo, hi = F.floor(at), F.ceil(at)
        name = point_name(p)
        aggs += [
            F.min(F.when(F.col("_upto") > lo, F.col("value"))).alias(name + "_lo"),
            F.min(F.when(F.col("_upto") > hi, F.col("value"))).alias(name + "_hi"),
            F.max(at - lo).alias(name + "_f"),
        ]
    got = ranked.groupBy(*groups).agg(F.max("_all").alias("n"), *aggs)
    mid = lambda a: F.col(a + "_lo") + (F.col(a + "_hi") - F.col(a + "_lo")) * F.col(a + "_f")
    return got.select(*groups, "n", *[mid(point_name(p)).alias(point_name(p)) for p in points])


def point_name(p: float) -> str:
    return "p" + f"{p * 100:05.2f}".replace(".", "_").removesuffix("_00")
