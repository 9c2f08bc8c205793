"""Spikes, stuck values and impossible readings, judged against the source's own behaviour."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.operators.missing import no_number
from gridlake.runtime import BROADCAST_GROUPS, cut, require, sorted_groups

HOUR_US = 3_600_000_000
NEAR = 3  # hours before and after a spike that it is compared with, twice as many where these have no reading
DAYS = 7  # days on either side whose same hour it is compared with
AROUND = 72  # hours of a run of zeros around a reading that decide together
MARGIN = 24 * (DAYS + 4)  # hours beyond a block that its readings are seen with
STEPS = 16  # steps a power of two by which details are counted


def flag_faults(
    df: DataFrame,
    id_column: str = "reading_id",
    source: str = "sensorid",
    time: str = "reading_ts",
    fields: tuple[str, str] = ("qe", "temperature"),
    bounds: tuple[tuple[float, float], tuple[float, float]] = ((0.0, float("inf")), (-60.0, 60.0)),
    relative: tuple[bool, bool] = (True, False),
    least: tuple[float, float] = (0.75, 3.0),
    stuck: int = 10,
    sigmas: float = 6.0,
    chunk_hours: int = 2016,
) -> DataFrame:
    """One row per faulty cell: id_column, field, fault ('spike', 'stuck' or 'impossible').

    The hourly series of a source (of a ``relative`` field its logarithm) is decomposed with the
    undecimated Haar wavelet. The source's scale is the robust deviation of its finest details, over
    all its readings: blocks count their details, the counts are added up.

    * impossible: outside ``bounds`` of the field.
    * stuck: in a run of ``stuck`` or more successive readings whose finest details are zero, repeated
      deliveries counting once; missing cells and other faults inside don't end a run. A zero of a
      relative field is the building's habit if, of the run's hours around it, half or more were
      zero too a week before or after, or on half of the days around, outside the run.
    * spike: the robust details (the reading less a median instead of a mean) towards the hours before,
      the hours after, and the same hour on the days around all have one sign and exceed ``sigmas``
      times the source's scale, and ``least`` (log ratio or units), and so does the Haar detail of one
      of the two finest scales at its edges, by half as much. Lasting changes have no detail towards
      one side, busy days none towards their neighbour hours.

    Missing cells (no_number()) are never faulty. Rows without source or time can only be
    impossible. Values delivered for one hour are judged together by their median. A source is
    worked in blocks of ``chunk_hours`` with a margin on both sides, which every comparison fits in,
    so no block grows with the source and the flags don't depend on the blocks. Readings over a week
    apart aren't successive. Extra columns are ignored; an empty table gives an empty result.
    """
    require(df, id_column, source, time, *fields)
    hour = F.floor(F.unix_micros(F.col(time).cast("timestamp")) / HOUR_US)
    low, high = F.floor((hour - MARGIN) / chunk_hours), F.floor((hour + MARGIN) / chunk_hours)
    rows = df.select(
        F.col(id_column).alias("id"), F.col(source).alias("s"), hour.alias("h"),
        *[F.when(~no_number(F.col(f).cast("double")), F.col(f).cast("double")).alias(k) for f, k in zip(fields, "ab", strict=True)],
        F.explode(F.when((hour.isNull() | F.col(source).isNull()), F.array(F.lit(None).cast("bigint"))).otherwise(F.sequence(low, high))).alias("c"),
    )
    known = rows.where("c IS NOT NULL AND (a IS NOT NULL OR b IS NOT NULL)")

    def judge(pdf: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
        g = np.zeros(len(pdf), np.int64)
        g[begin[1:]] = 1
        g = np.cumsum(g)
        h, c, ids, s = (pdf[k].to_numpy() for k in ("h", "c", "id", "s"))
        mine = h // chunk_hours == c
        parts = []
        for k, name in enumerate(fields):
            v = pdf["ab"[k]].to_numpy(dtype=float)
            got = judge_field(g, h, v, bounds[k], relative[k], least[k], stuck)
            at = np.flatnonzero((got.fault > 0) & mine)
            parts.append(pd.DataFrame({"s": s[at], "field": name, "id": ids[at], "fault": np.array(["", "impossible", "stuck", "spike"])[got.fault[at]], "leaves": got.leaves[at], "detail": got.detail[at], "step": 0, "n": 0}))
            at = np.flatnonzero(np.isfinite(got.finest) & mine)
            # Counts of the block's finest details by size; each hour once.
            with np.errstate(divide="ignore"):
                step = np.maximum(np.round(STEPS * np.log2(got.finest[at])), -1000).astype(np.int64)
            keys, n = np.unique(g[at] * 4096 + step + 2048, return_counts=True)
            parts.append(pd.DataFrame({"s": s[begin[keys // 4096]], "field": name, "id": ids[0], "fault": "", "leaves": 0.0, "detail": 0.0, "step": keys % 4096 - 2048, "n": n}))
        return pd.concat(parts, ignore_index=True)

    kind, source_kind = (df.schema[c].dataType.simpleString() for c in (id_column, source))
    found = cut(sorted_groups(known, ["s", "c"], ["h", "id"], judge, f"s {source_kind}, field string, id {kind}, fault string, leaves double, detail double, step bigint, n bigint"))
    sizes = found.where("fault = ''").groupBy("s", "field", "step").agg(F.sum("n").alias("n")).groupBy("s", "field").agg(F.array_sort(F.collect_list(F.struct("step", "n"))).alias("steps"))
    half = F.aggregate("steps", F.lit(0).cast("bigint"), lambda acc, x: acc + x["n"]) / 2
    upto = lambda acc, x: F.struct((acc["n"] + x["n"]).alias("n"), F.when(acc["n"] < half, x["step"]).otherwise(acc["step"]).alias("step"))
    middle = F.aggregate("steps", F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("step")), upto)["step"]
    scales = cut(sizes.select("s", "field", (1.4826 * F.pow(F.lit(2.0), middle / STEPS)).alias("scale")))
    scales = F.broadcast(scales) if scales.count() <= BROADCAST_GROUPS else scales
    spikes = found.where("fault = 'spike'").join(scales, ["s", "field"], "left")
    spikes = spikes.where((F.col("leaves") > sigmas * F.coalesce("scale", F.lit(0.0))) & (F.col("detail") > 0.8 * sigmas * F.coalesce("scale", F.lit(0.0))))
    sure = found.where("fault IN ('stuck', 'impossible')")
    loose = rows.where("c IS NULL").select("id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), ((F.col(k) < lo) | (F.col(k) > hi)).alias("bad")) for f, k, (lo, hi) in zip(fields, "ab", bounds, strict=True)
    ])).alias("x")).where("x.bad").select("id", "x.field", F.lit("impossible").alias("fault"))
    names = ["id", "field", "fault"]
    return spikes.select(names).unionByName(sure.select(names)).unionByName(loose).withColumnRenamed("id", id_column)


class Judged:
    """Per row: fault (1 impossible, 2 stuck, 3 may be a spike, 0 none), by how much it leaves all it is compared with, the largest detail at its edges, the finest detail of its hour (NaN but for one row an hour)."""

    def __init__(self, n: int) -> None:
        self.fault = np.zeros(n, np.int8)
        self.leaves, self.detail, self.finest = np.zeros(n), np.zeros(n), np.full(n, np.nan)


def judge_field(s: np.ndarray, h: np.ndarray, v: np.ndarray, bound: tuple[float, float], relative: bool, least: float, stuck: int) -> Judged:
    """What can be said of rows sorted by group s and hour h without the source's scale."""
    out = Judged(len(v))
    bad = (v < bound[0]) | (v > bound[1])
    out.fault[bad] = 1
    # One value per group and hour: the median of what was delivered.
    use = np.flatnonzero(np.isfinite(v) & ~bad)
    if not len(use):
        return out
    key = np.concatenate([[True], (s[use][1:] != s[use][:-1]) | (h[use][1:] != h[use][:-1])])
    of = np.cumsum(key) - 1
    start = np.flatnonzero(key)
    first = use[start]
    count = np.diff(np.append(start, len(use)))
    ordered = v[use][np.lexsort((v[use], of))]
    w = (ordered[start + (count - 1) // 2] + ordered[start + count // 2]) / 2
    g, t = s[first], h[first]
    begin = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
    size = np.diff(np.append(begin, len(g)))
    group = np.repeat(np.arange(len(begin)), size)
    # A dense hourly grid from midnight on: group after group with empty margins, so shifts never reach another group.
    pad = 24 * (DAYS + 1)
    day0 = t[begin] // 24
    days = t[begin + size - 1] // 24 - day0 + 1
    origin = np.concatenate([[0], np.cumsum(24 * days + pad)])[:-1] + pad
    pos = origin[group] + t - 24 * day0[group]
    y = np.full(int(origin[-1] + 24 * days[-1] + pad), np.nan)
    if relative:
        y[pos] = w
        y[pos] = np.log(w + 0.02 * _level(y)[pos // 24])
    else:
        y[pos] = w
    x = y[pos]
    out.finest[first] = np.abs(x - y[pos - 1]) / np.sqrt(2)
    # Away from the hours before and after a spike of one to three hours that the reading may be part of.
    lead, trail = (np.full(len(y), np.nan) for _ in "bb")
    for width in (NEAR, 2 * NEAR):  # twice as far where there is nothing near
        windows = _median(np.lib.stride_tricks.sliding_window_view(y, width).copy())
        lead[width:] = np.where(np.isnan(lead[width:]), windows[:-1], lead[width:])
        trail[:-width] = np.where(np.isnan(trail[:-width]), windows[1:], trail[:-width])
    leaves, side = np.full(len(w), -np.inf), np.zeros(len(w), np.int8)
    for length in (1, 2, 3):
        for k in range(length):
            before, after = lead[pos - k], trail[pos - k + length - 1]
            with np.errstate(invalid="ignore"):
                up, down = x - np.fmax(before, after), np.fmin(before, after) - x
            far = np.fmax(up, down)
            better = far > leaves
            leaves[better], side[better] = far[better], np.where(up > down, 1, -1)[better] * np.where(np.isnan(before) | np.isnan(after), 2, 1)[better]
    maybe = np.flatnonzero(leaves > least)
    p = pos[maybe]
    around = _median(y[p[:, None] + np.array([24 * k + j for k in range(-DAYS, DAYS + 1) if k for j in (-1, 0, 1)])])
    # One unknown of the three is allowed.
    away = np.where(np.isnan(around), np.where(np.abs(side[maybe]) == 1, np.inf, -np.inf), (x[maybe] - around) * np.sign(side[maybe]))
    leaves = np.minimum(leaves[maybe], away)
    # The largest step between successive readings where the spike may begin or end.
    step = np.abs(np.diff(x, prepend=np.nan)) / np.sqrt(2)
    step[1:][(np.diff(t) > 2 * NEAR + 1) | (np.diff(group) != 0)] = np.nan
    edges = np.concatenate([[np.nan] * 3, step, [np.nan] * 4])[maybe[:, None] + 3 + np.arange(-2, 4)]
    detail = np.where(np.isnan(edges).all(axis=1), np.inf, np.fmax.reduce(edges, axis=1))
    spike = np.zeros(len(w), bool)
    spike[maybe[leaves > least]] = True
    if relative:
        zeros = np.flatnonzero(spike & (w == 0))
        run, first_of, length = _runs(w, group, t)
        spike[zeros] = ~_habit(w == 0, run, pos, first_of, length, zeros, len(y))
    big, edge = np.zeros(len(w)), np.zeros(len(w))
    big[maybe], edge[maybe] = leaves, detail
    runs = _stuck(w, group, t, pos, len(y), spike, stuck, relative)
    out.fault[use] = np.where(runs, 2, np.where(spike, 3, 0)).astype(np.int8)[of]
    out.leaves[use], out.detail[use] = big[of], edge[of]
    return out


def _level(y: np.ndarray) -> np.ndarray:
    """Per day of a dense hourly grid the median of the positive values' daily medians of the week before to the week after; 1 without any."""
    daily = np.full(len(y) // 24 + 1, np.nan)
    hours = np.where(y > 0, y, np.nan)[: len(y) // 24 * 24].reshape(-1, 24)
    some = np.isfinite(hours).any(axis=1)
    daily[:-1][some] = _median(hours[some])
    padded = np.concatenate([np.full(DAYS, np.nan), daily, np.full(DAYS, np.nan)])
    out = _median(np.lib.stride_tricks.sliding_window_view(padded, 2 * DAYS + 1).copy())
    return np.where(np.isfinite(out), out, 1.0)


def _median(x: np.ndarray) -> np.ndarray:
    """Median of each row without its NaNs; NaN for none."""
    x = np.sort(x, axis=1)
    n = np.isfinite(x).sum(axis=1)
    i = np.arange(len(x))
    hi, lo = np.maximum(n // 2, 0), np.maximum((n - 1) // 2, 0)
    out = (x[i, np.minimum(hi, x.shape[1] - 1)] + x[i, lo]) / 2
    out[n == 0] = np.nan
    return out


def _stuck(w: np.ndarray, group: np.ndarray, t: np.ndarray, pos: np.ndarray, cells: int, spike: np.ndarray, least: int, zero_is_habit: bool) -> np.ndarray:
    """TRUE in runs of zero details over at least ``least`` readings; spikes inside a run are passed over."""
    keep = np.flatnonzero(~spike)
    out = np.zeros(len(w), bool)
    if not len(keep):
        return out
    v = w[keep]
    run, begin, size = _runs(v, group[keep], t[keep])
    fault = np.repeat(size >= least, size)
    if zero_is_habit:
        ask = np.flatnonzero(fault & (v == 0))
        fault[ask] = ~_habit(v == 0, run, pos[keep], begin, size, ask, cells)
    out[keep] = fault
    return out


def _runs(v: np.ndarray, group: np.ndarray, t: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run of each reading, first reading, length) of the runs of zero details."""
    begin = np.flatnonzero(np.concatenate([[True], (np.diff(v) != 0) | (np.diff(group) != 0) | (np.diff(t) > 24 * DAYS)]))
    size = np.diff(np.append(begin, len(v)))
    return np.repeat(np.arange(len(begin)), size), begin, size


def _habit(zero: np.ndarray, run: np.ndarray, pos: np.ndarray, begin: np.ndarray, size: np.ndarray, ask: np.ndarray, cells: int) -> np.ndarray:
    """Of the readings ``ask`` in runs of zeros: whether half of their run's hours around are mostly zero outside it too."""
    if not len(ask):
        return np.zeros(0, bool)
    state, owner = np.full(cells, -1, np.int8), np.full(cells, -1)
    state[pos], owner[pos] = zero, run
    known, zeros, week = np.zeros(len(ask), int), np.zeros(len(ask), int), np.zeros(len(ask), bool)
    for k in (k for k in range(-DAYS, DAYS + 1) if k):
        there = pos[ask] + 24 * k
        other = (state[there] >= 0) & (owner[there] != run[ask])
        known += other
        zeros += other & (state[there] == 1)
        if abs(k) == 7:
            week |= other & (state[there] == 1)
    usual = np.zeros(len(pos) + 1)
    usual[ask + 1] = week | ((known > 0) & (2 * zeros >= known))
    usual = np.cumsum(usual)
    low = np.maximum(np.searchsorted(pos, pos[ask] - AROUND), begin[run[ask]])
    high = np.minimum(np.searchsorted(pos, pos[ask] + AROUND, "right"), begin[run[ask]] + size[run[ask]])
    return 2 * (usual[high] - usual[low]) >= high - low
