"""Scalar, calendar, Fourier, lag, filter and degree-day features, and normalisation."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.period import bucket, seconds
from gridlake.operators.blocks import in_blocks, row_blocks, rows_of, sorted_blocks
from gridlake.runtime import cut, require


def calendar_components(df: DataFrame, tz: str, time: str = "time", holidays: list[str] | None = None) -> DataFrame:
    """Add the calendar columns of the local time. ``holidays``: ISO dates, as many as a calendar has."""
    require(df, time)
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), tz)
    md, hour, dow = F.date_format(local, "MMdd"), F.hour(local), F.weekday(local) + 1
    days = [F.lit(d) for d in holidays or []]
    date = F.to_date(local)
    off = F.date_format(date, "yyyy-MM-dd").isin(*days) if days else F.lit(False)
    season = F.when((md >= "1215") | (md < "0315"), "Winter").when(md < "0615", "Spring").when(md < "0915", "Summer").otherwise("Fall")
    out = {
        "localtime": local, "date": date, "weekday": dow, "weekdayNum": dow, "dayYear": F.dayofyear(local), "timestamp": F.unix_timestamp(F.col(time).cast("timestamp")),
        "isWeekend": dow >= 6, "isHolidays": off, "holidaysDate": F.when(off, date), "year": F.year(local), "quarter": F.quarter(local), "semester": F.when(F.quarter(local) <= 2, 1).otherwise(2),
        "season": F.when(local.isNotNull(), season), "monthInt": F.month(local), "month": F.month(local), "day": F.dayofmonth(local), "hour": hour,
        **{f"hourBy{k}": F.ceil((hour + 1) / k) for k in (3, 4, 6, 8)}, "weekhour": hour + 24 * (dow - 1), "minute": F.minute(local), "second": F.second(local),
    }
    return df.withColumns(out)


def free_days_per_month(spark_dates: DataFrame, holidays: list[str]) -> DataFrame:
    """(month, holidaysPerMonth): weekends and holidays of each month between the first and last ``date``; 0 without holidays."""
    ends = spark_dates.agg(F.trunc(F.min("date"), "month").alias("a"), F.last_day(F.max("date")).alias("z"))
    days = ends.where("a IS NOT NULL").select(F.explode(F.sequence("a", "z")).alias("d"))
    free = (F.weekday("d") >= 5) | (F.date_format("d", "yyyy-MM-dd").isin(holidays) if holidays else F.lit(False))
    return days.groupBy(F.trunc("d", "month").alias("month")).agg((F.sum(free.cast("int")) if holidays else F.lit(0)).alias("holidaysPerMonth"))


def fourier(c: Column, name: str, harmonics: int) -> list[Column]:
    """sin and cos of the first harmonics of a feature scaled to a turn, and the intercept."""
    both = [f(F.lit(2 * math.pi * i) * c).alias(f"{name}_{n}_{i}") for i in range(1, harmonics + 1) for n, f in (("sin", F.sin), ("cos", F.cos))]
    return [*both, F.lit(1.0).alias(f"{name}_fs_int")]


def fourier_components(df: DataFrame, features: list[str], harmonics: int, mask: Column | None = None, limits: dict[str, tuple[float, float]] | None = None, ranged: bool = False) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Fourier columns of features divided by their maximum plus one or, if ``ranged``, scaled from their minimum to their maximum; the limits are returned for later data.

    Where ``mask`` is TRUE the scaled feature is 0 before the series is built.
    """
    require(df, *features)
    if limits is None:
        row = df.agg(*[g(F.col(f).cast("double")).alias(f"{n}_{f}") for f in features for n, g in (("lo", F.min), ("hi", F.max))]).first()
        # x is scaled as (x - low) / width.
        limits = {f: ((row[f"lo_{f}"] or 0.0, (row[f"hi_{f}"] or 0.0) - (row[f"lo_{f}"] or 0.0) or 1.0) if ranged else (0.0, (row[f"hi_{f}"] or 0.0) + 1)) for f in features}
    cols = []
    for f in features:
        low, width = limits[f]
        x = (F.col(f).cast("double") - low) / width
        cols += fourier(F.when(mask, 0.0).otherwise(x) if mask is not None else x, f, harmonics)
    return df.select("*", *cols), limits


def lag_components(df: DataFrame, keys: list[str], features: list[str], lags: list[int], time: str = "time", extend: bool = False, force: dict[str, Column] | None = None, before: DataFrame | None = None) -> DataFrame:
    """Add {feature}_l{k}; ``extend`` fills the first rows of a series with its first value.

    Series are worked in blocks of rows, each seen with as many rows before it as the largest lag.
    ``force`` replaces features by columns or literals first. ``before``: rows (keys, time, features) kept
    from earlier, such as last_rows() of the training data; lags of the first rows are taken from them.
    """
    df = df.withColumns(force) if force else df
    require(df, time, *keys, *features)
    own = df.columns
    if before is not None:
        df = df.withColumn("_own", F.lit(True)).unionByName(before.select(*keys, time, *features).withColumn("_own", F.lit(False)), allowMissingColumns=True)
    lagged = {f"{f}_l{k}": F.lag(f, k).over(rows_of()) for f in features for k in lags}
    out = row_blocks(df, keys, time, max(lags)).withColumns(lagged).where("_mine")
    if extend:
        firsts = df.groupBy(*keys).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(time))).alias(f"_first{i}") for i, f in enumerate(features)])
        firsts = firsts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_first{i}" for i in range(len(features))])
        out = out.join(firsts, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        out = out.withColumns({f"{f}_l{k}": F.coalesce(f"{f}_l{k}", f"_first{i}") for i, f in enumerate(features) for k in lags})
    return (out.where("_own") if before is not None else out).select(*own, *lagged)


def last_rows(df: DataFrame, keys: list[str], columns: list[str], n: int, time: str = "time") -> DataFrame:
    """(keys..., time, columns...): each series' last n rows, to begin the lags of later data with."""
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    return df.select(*keys, time, *columns, back.alias("_n")).where(F.col("_n") <= n).drop("_n")


def low_pass(df: DataFrame, keys: list[str], features: list[str], alpha: float, time: str = "time", chunk: str = "P30D") -> DataFrame:
    """Add {feature}_lpf: y = alpha * previous y + (1 - alpha) * x per series; a NULL restarts the filter.

    The recurrence is linear, so blocks of time are folded side by side from zero, by doubling steps;
    what a block hands on is a power of alpha times what it got. Only one row per block is then folded
    per series. Rows of the same time are taken in order of their features; rows without a time get
    NULL.
    """
    require(df, time, *keys, *features)
    own = df.columns
    rows = in_blocks(df, keys, time, chunk)

    def fold(table: pa.Table, begin: np.ndarray) -> dict[str, pa.Array]:
        out = {}
        n = table.num_rows
        at = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
        for i, f in enumerate(features):
            x = table.column(f).cast(pa.float64()).to_numpy()
            known = np.isfinite(x)
            y, a = np.where(known, (1 - alpha) * x, 0.0), np.where(known, alpha, 0.0)
            p = a.copy()
            step = 1
            while step < (at.max() + 1 if n else 1):
                inner = at >= step
                before = np.flatnonzero(inner) - step
                y_new, p_new = y.copy(), p.copy()
                y_new[inner] += p[inner] * y[before]
                p_new[inner] *= p[before]
                y, p, step = y_new, p_new, 2 * step
            # p: the factor with which the value before the block still counts.
            out[f"_y{i}"], out[f"_p{i}"] = pa.array(y), pa.array(p)
            out[f"_ok{i}"] = pa.array(known)
        return out

    add = ", ".join(f"_y{i} double, _p{i} double, _ok{i} boolean" for i in range(len(features)))
    folded = cut(sorted_blocks(rows, ["_g"], [F.asc(time), *[F.asc(f) for f in features]], fold, add))
    last = F.struct(F.col(time), *features)
    tails = folded.where("_g.c IS NOT NULL").groupBy("_g").agg(*[F.max_by(F.struct(f"_y{i}", f"_p{i}"), last).alias(f"_t{i}") for i in range(len(features))])
    packed = tails.groupBy(F.col("_g.k").alias("_s")).agg(F.array_sort(F.collect_list(F.struct(F.col("_g.c").alias("c"), *[f"_t{i}" for i in range(len(features))]))).alias("_a"))  # a row per block

    def chain(i: int) -> Column:
        step = lambda acc, x: F.struct((x[f"_t{i}"][f"_y{i}"] + x[f"_t{i}"][f"_p{i}"] * acc["y"]).alias("y"), F.concat(acc["got"], F.array(acc["y"])).alias("got"))
        return F.aggregate("_a", F.struct(F.lit(0.0).alias("y"), F.expr("CAST(array() AS array<double>)").alias("got")), step)["got"]

    carried = packed.select("_s", F.inline(F.arrays_zip(F.transform("_a", lambda x: x["c"]).alias("c"), *[chain(i).alias(f"_in{i}") for i in range(len(features))])))
    carried = carried.select(F.struct(F.col("_s").alias("k"), "c").alias("_g"), *[f"_in{i}" for i in range(len(features))])
    got = {f"{f}_lpf": F.when(F.col(f"_ok{i}") & F.col(time).isNotNull(), F.col(f"_y{i}") + F.col(f"_p{i}") * F.coalesce(f"_in{i}", F.lit(0.0))) for i, f in enumerate(features)}
    return folded.join(carried, "_g", "left").withColumns(got).select(*own, *got)


def smoothing_scale(hours: float, step: str) -> float:
    """alpha of low_pass() for a time constant in hours and the data's step."""
    return math.exp(-(3600 / seconds(step)) / (2 * math.pi * hours / 24))


def degree_raw(t: Column, base: Column, mode: str, hysteresis: float = 2.0, most: float | None = None) -> Column:
    """Degrees below (heating) or above (cooling) the base, 0 on its other side, at most ``most``; NULL stays NULL."""
    h = abs(hysteresis)
    d = F.when(t < base, base + h - t) if mode == "heating" else F.when(t > base, t - (base - h))
    d = F.when(t.isNotNull() & base.isNotNull(), F.coalesce(d, F.lit(0.0)))
    return d if most is None else F.when(d.isNotNull(), F.least(d, F.lit(most)))


def degree_days(df: DataFrame, keys: list[str], temperature: str, bases: list[float], mode: str, tz: str, output: str = "P1D", hysteresis: float = 2.0, name: str = "degreeDays", time: str = "time") -> DataFrame:
    """(keys..., time, {name}{base}...): degrees of the local daily means, summed over ``output``."""
    require(df, time, temperature, *keys)
    days = df.groupBy(*keys, bucket(F.col(time).cast("timestamp"), "P1D", tz).alias("_d")).agg(F.avg(temperature).alias("_t"))
    label = lambda b: f"{name}{b:g}"
    return days.groupBy(*keys, bucket(F.col("_d"), output, tz).alias("time")).agg(*[F.sum(degree_raw(F.col("_t"), F.lit(float(b)), mode, hysteresis)).alias(label(b)) for b in bases])


def boxcox(x: Column, lam: float) -> Column:
    return F.when(x > 0, F.log(x) if abs(lam) < 1e-9 else (F.pow(x, F.lit(lam)) - 1) / lam)


def boxcox_inverse(y: Column, lam: float) -> Column:
    return F.exp(y) if abs(lam) < 1e-9 else F.when(lam * y + 1 > 0, F.exp(F.log(lam * y + 1) / lam))


def boxcox_lambda(df: DataFrame, value: str, steps: int = 81) -> float:
    """The lambda in [-2, 2] with the highest profile likelihood of a constant mean, in one pass over the positive values."""
    x = F.when(F.col(value) > 0, F.col(value).cast("double"))
    grid = [-2 + 4 * i / (steps - 1) for i in range(steps)]
    row = df.agg(F.count(x).alias("n"), F.sum(F.log(x)).alias("s"), *[F.var_pop(boxcox(x, 0.0 if abs(g) < 1e-12 else g)).alias(f"v{i}") for i, g in enumerate(grid)]).first()
    score = [(-(row["n"] / 2) * math.log(row[f"v{i}"]) + (g - 1) * row["s"], -abs(g), g) for i, g in enumerate(grid) if row[f"v{i}"]]
    return max(score)[2] if score else 1.0


def normalise_range(df: DataFrame, columns: list[str], lower: float = 0.0, upper: float = 1.0, limits: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns scaled to [lower, upper]; a constant column becomes ``lower``. Limits are returned for later data."""
    require(df, *columns)
    if lower > upper:
        raise ValueError("lower is over upper")
    if limits is None:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))]).first()
        limits = {c: (row[f"lo_{c}"], row[f"hi_{c}"]) for c in columns}
    out = {}
    for c in columns:
        lo, hi = limits[c]
        flat = lo is None or lo == hi
        out[c] = F.when(F.col(c).isNotNull(), F.lit(lower)) if flat else (F.col(c) - lo) / (hi - lo) * (upper - lower) + lower
    return df.withColumns(out), limits


def normalise_zscore(df: DataFrame, columns: list[str], scaling: dict[str, tuple[float, float]] | None = None) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """Columns less their mean over their sample deviation; both are returned for later data."""
    require(df, *columns)
    if scaling is None:
        row = df.agg(*[f(F.col(c).cast("double")).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_samp))]).first()
        scaling = {c: (row[f"m_{c}"], row[f"s_{c}"]) for c in columns}
    return df.withColumns({c: F.try_divide(F.col(c) - F.lit(scaling[c][0]), F.lit(scaling[c][1])) for c in columns}), scaling


def normalise_daily(df: DataFrame, keys: list[str], value: str, tz: str, time: str = "time") -> DataFrame:
    """``value`` as a share of its local day's total; NULL on days with a NULL."""
    require(df, time, value, *keys)
    w = Window.partitionBy(*keys, F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), tz)))
    whole = F.count(value).over(w) == F.count(F.lit(1)).over(w)
    return df.withColumn(value, F.when(whole, F.try_divide(F.col(value), F.sum(value).over(w))))
