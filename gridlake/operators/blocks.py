"""Series in blocks of time, so that a series with a third of all rows is many tasks; only a row per block is ordered per series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from gridlake.functions.period import seconds

CHUNK = "P30D"


def in_blocks(df: DataFrame, keys: list[str], time: str, chunk: str = CHUNK) -> DataFrame:
    """df with ``_g``: its keys and number of block, compared as a whole, so NULL keys are a series too."""
    return df.withColumn("_g", F.struct(F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)]).alias("k"), F.floor(F.unix_seconds(F.col(time).cast("timestamp")) / seconds(chunk)).alias("c")))


def inside(time: str, back: bool = False) -> WindowSpec:
    """Order within a block, from its end if ``back``: frames up to a partition's end are gone through for every row."""
    return Window.partitionBy("_g").orderBy(F.desc(time) if back else F.asc(time))


def carry(rows: DataFrame, before: dict[str, Column] | None = None, after: dict[str, Column] | None = None, sums: dict[str, Column] | None = None) -> DataFrame:
    """rows of in_blocks() with what other blocks of the series hand on.

    Each column is an aggregate of a block. ``before``: its last known value in earlier blocks;
    ``after``: its first known one in later blocks; ``sums``: its sum over earlier blocks, 0 for none.
    The rows are already partitioned by block, so joining this on moves one row per block only.
    """
    both = {**(before or {}), **(after or {}), **(sums or {})}
    blocks = rows.groupBy("_g").agg(*[c.alias(n) for n, c in both.items()])
    w = Window.partitionBy("_g.k").orderBy(F.asc("_g.c")).rowsBetween(Window.unboundedPreceding, -1)
    z = Window.partitionBy("_g.k").orderBy(F.desc("_g.c")).rowsBetween(Window.unboundedPreceding, -1)
    out = {n: F.last(n, True).over(w) for n in before or {}} | {n: F.last(n, True).over(z) for n in after or {}} | {n: F.coalesce(F.sum(n).over(w), F.lit(0)) for n in sums or {}}
    return rows.join(blocks.select("_g", *[c.alias(n) for n, c in out.items()]), "_g")


def numbered(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """df with ``_g`` of in_blocks() and ``_r``: its row numbers in its series by time, from 0."""
    rows = carry(in_blocks(df, keys, time), sums={"_before": F.count("*")})
    return rows.withColumn("_r", F.row_number().over(inside(time)) + F.col("_before") - 1).drop("_before")


def row_blocks(df: DataFrame, keys: list[str], time: str, reach: int, size: int = 20_000) -> DataFrame:
    """df in blocks of ``size`` rows of a series, each seen with the ``reach`` rows before it: ``_r``, the block ``_b``, and ``_mine`` for the rows that are its own.

    Windows over rows_of() see up to ``reach`` rows back whatever the block; keep ``_mine`` afterwards.
    """
    size = max(size, 4 * reach)
    block = lambda r: F.floor(r / size)
    rows = numbered(df, keys, time)
    rows = rows.withColumn("_at", F.explode(F.sequence(block(F.col("_r")), block(F.col("_r") + reach))))
    return rows.withColumns({"_b": F.struct(F.col("_g.k").alias("k"), F.col("_at").alias("b")), "_mine": F.col("_at") == block(F.col("_r"))}).drop("_at", "_g")


def rows_of() -> WindowSpec:
    return Window.partitionBy("_b").orderBy("_r")


def sorted_blocks(df: DataFrame, keys: list[str], order: list[Column], fn: Callable[[pa.Table, np.ndarray], dict[str, pa.Array]], add: str) -> DataFrame:
    """df with columns computed by ``fn`` from whole groups of ``keys``: rows as an Arrow table, where groups begin -> columns named as in ``add``.

    Rows are hashed by the keys and sorted once; other columns pass through untouched. Only the group
    cut by a batch's end is carried on: keep groups bounded.
    """
    kept = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for batch in _and_end(batches):
            if batch is not None:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            if held is None or not held.num_rows:
                continue
            h = held.column("_h").to_numpy()
            begin = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            stop = held.num_rows if batch is None else int(begin[-1])
            if stop:
                whole = held.slice(0, stop)
                new = fn(whole, begin[begin < stop])
                whole = whole.drop_columns(["_h"])
                for n, a in new.items():
                    whole = whole.append_column(n, a)
                yield from whole.combine_chunks().to_batches()
            held = held.slice(stop)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    h = df.withColumn("_h", F.xxhash64(*keys))
    return h.repartition("_h").sortWithinPartitions("_h", *order).mapInArrow(run, f"{schema}, {add}").select(*kept, *[part.strip().split(" ")[0] for part in add.split(",")])


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None
