"""Online forms of the series operators for Structured Streaming."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_resample(df: DataFrame, keys: list[str], window: str, late: str, time: str = "time", value: str = "value", weekly: bool = False) -> DataFrame:
    """Tumbling-window sums, means and counts; rows later than ``late`` behind the newest are dropped. ``weekly`` windows begin on Monday."""
    w = F.window(time, window, startTime="4 days") if weekly else F.window(time, window)
    got = df.withWatermark(time, late).groupBy(*keys, w.alias("w")).agg(F.sum(value).alias("SUM"), F.avg(value).alias("AVG"), F.count("*").alias("count"))
    return got.select(*keys, F.col("w.start").alias("time"), "SUM", "AVG", "count")


def stream_low_pass(df: DataFrame, key: str, alpha: float, time: str = "time", value: str = "value") -> DataFrame:
    """(key, time, value, value_lpf, late): the filter's last output and time are the state of each series.

    The rows a trigger brings of a series are put in order of time together. Rows older than what
    the filter has already folded can't change it any more: they come out marked ``late``, with NULL.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        y, last = state.get if state.exists else (None, None)
        pdf = pd.concat(list(frames), ignore_index=True).sort_values(time, kind="stable")
        late = np.zeros(len(pdf), bool) if last is None else (pdf[time] < pd.Timestamp(last, unit="us")).to_numpy()
        out = []
        for x, old in zip(pdf[value], late, strict=True):
            if not old:
                y = None if pd.isna(x) else alpha * (y or 0.0) + (1 - alpha) * x
            out.append(None if old else y)
        yield pd.DataFrame({key: k[0], time: pdf[time], value: pdf[value], f"{value}_lpf": pd.Series(out, index=pdf.index, dtype="float64"), "late": late})
        newest = pdf[time].max()
        if not pd.isna(newest):
            newest = int(newest.value // 1000)
            last = newest if last is None else max(last, newest)
        state.update((y, last))

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {time} timestamp, {value} double, {value}_lpf double, late boolean"
    return df.groupBy(key).applyInPandasWithState(step, schema, "y double, last long", "append", GroupStateTimeout.NoTimeout)
