"""Session helpers shared by the operators: shared storage, lineage cuts, grouped streaming."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Rows of a table with a row per group that are broadcast at most (some 100 bytes each).
BROADCAST_GROUPS = 100_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir where the cluster names one.

    Only where nothing is set (tests, one machine) a temporary folder of this process is used.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if named:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(named)
        return named
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        made = tempfile.mkdtemp(prefix="gridlake-")
        atexit.register(shutil.rmtree, made, True)
        sc.setCheckpointDir(made)
    return str(sc.getCheckpointDir())


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write a table to the shared folder, where it survives the loss of executors, and read it.

    A checkpoint would keep the size the optimiser guessed for the plan. A join's guess is the
    product of its sides, so in loops of joins the guesses square until they fill the memory.
    """
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/gridlake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _WRITTEN[path] = df.sparkSession
    out._gridlake_path = path
    return out


_WRITTEN: dict[str, SparkSession] = {}


def keep_until_exit(spark: SparkSession, path: str) -> str:
    """The path, which will be deleted when the process ends."""
    _WRITTEN[path] = spark
    return path


def discard(df: DataFrame) -> None:
    """Delete the table of a cut() that nothing will read again."""
    _delete(getattr(df, "_gridlake_path", ""))


def _delete(path: str) -> None:
    spark = _WRITTEN.pop(path, None)
    if spark is not None and spark.sparkContext._jsc is not None:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _delete_all() -> None:
    for path in list(_WRITTEN):
        try:
            _delete(path)
        except Exception:  # noqa: BLE001 - the session may have ended before
            shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), True)


def share_file(spark: SparkSession, label: str, content: bytes) -> str:
    """Put a file into the shared folder, on whatever file system, and have Spark copy it to every executor; SparkFiles.get() of the name returned finds it."""
    name = f"gridlake-{label}-{uuid.uuid4().hex}"
    path = f"{shared_dir(spark).rstrip('/')}/{name}"
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(content))
    out.close()
    _WRITTEN[path] = spark
    spark.sparkContext.addFile(path)
    return name


def require(df: DataFrame, *columns: str) -> None:
    """Fail early and by name when an input lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}; there are {', '.join(df.columns)}")


def is_finite(c: Column) -> Column:
    """TRUE for a number that is neither NULL, NaN nor infinite; never NULL."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def sorted_groups(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    fn: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame],
    schema: str,
) -> DataFrame:
    """Apply ``fn`` to whole groups, many at a time, out of one shuffle and one sort.

    Rows are hashed by ``keys`` and sorted; Arrow batches stream through. ``fn`` gets a frame of
    complete groups and the row numbers where they begin, so one numpy call serves all groups of a
    batch. Only the group cut by a batch's end is carried on: keep groups bounded (chunk by time).
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            ks = [pdf[k].to_numpy() for k in keys]
            last = len(pdf) - 1
            same = np.ones(len(pdf), bool)
            for k in ks:
                same &= k == k[last]
            at = last - int(np.argmin(same[::-1])) + 1 if not same.all() else 0
            if at == 0 and held and all(held[-1][k].iloc[-1] == pdf[k].iloc[0] for k in keys):
                held.append(pdf)
                continue
            whole = pd.concat([*held, pdf.iloc[:at]], ignore_index=True) if held else pdf.iloc[:at]
            held = [pdf.iloc[at:]]
            if len(whole):
                yield fn(whole.reset_index(drop=True), starts(whole, keys))
        if held:
            whole = pd.concat(held, ignore_index=True)
            if len(whole):
                yield fn(whole, starts(whole, keys))

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def starts(pdf: pd.DataFrame, keys: list[str]) -> np.ndarray:
    """Row numbers at which the sorted frame's keys change; 0 comes first."""
    new = np.zeros(len(pdf), bool)
    new[:1] = True
    for k in keys:
        v = pdf[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(new)
