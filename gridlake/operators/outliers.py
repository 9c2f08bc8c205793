"""Outlier masks as boolean columns."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.numerics import quantile_regression
from gridlake.functions.period import bucket, seconds
from gridlake.operators.blocks import carry, in_blocks, row_blocks, rows_of
from gridlake.runtime import require


def static_min_max(c: Column, low: float | None = None, high: float | None = None, include_low: bool = True, include_high: bool = True) -> Column:
    """TRUE outside the bounds; a bound that isn't included is outside itself. NULL stays NULL."""
    under = F.lit(False) if low is None else (c < low if include_low else c <= low)
    over = F.lit(False) if high is None else (c > high if include_high else c >= high)
    return under | over


def static_regexp(c: Column, patterns: list[str], negative: bool = False) -> Column:
    """TRUE if any pattern is found in the text (``negative``: if none is); NULL contains nothing."""
    hit = F.lit(False)
    for p in patterns:
        hit = hit | F.coalesce(c.rlike(p), F.lit(False))
    return ~hit if negative else hit


def min_max_outliers(df: DataFrame, keys: list[str], low: float | None = None, high: float | None = None, low_series: DataFrame | None = None, high_series: DataFrame | None = None, time: str = "time", value: str = "value", fill: str = "ffill") -> DataFrame:
    """Add ``outlier``: outside fixed bounds, or bounds given as series (keys..., time, value).

    A bound series holds until its next value (``fill`` 'ffill') or at its own times only ('exact').
    Before its first value there is no bound. The mask is three-valued: NULL values give NULL.
    """
    require(df, time, value, *keys)
    out, masks = df, []
    for name, series, fixed, sign in (("_lo", low_series, low, -1), ("_hi", high_series, high, 1)):
        if series is not None:
            bound = series.select(*keys, F.col(time).alias(time), F.col(value).alias(name))
            if fill == "exact":
                out = out.join(bound, [*keys, time], "left")
            else:
                tag = [F.col(k) for k in keys]
                left = out.select(*tag, F.col(time), F.struct(*out.columns).alias("_row"), F.lit(None).cast("double").alias(name), F.lit(1).alias("_o"))
                right = bound.select(*tag, F.col(time), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"), F.col(name).cast("double").alias(name), F.lit(0).alias("_o"))
                both = carry(in_blocks(left.unionByName(right), keys, time), before={"_earlier": F.max_by(name, F.when(F.col(name).isNotNull(), F.struct(time, "_o")))})
                w = Window.partitionBy("_g").orderBy(time, "_o").rowsBetween(Window.unboundedPreceding, 0)
                out = both.withColumn(name, F.coalesce(F.last(name, ignorenulls=True).over(w), "_earlier")).where("_o = 1").select("_row.*", name)
        else:
            out = out.withColumn(name, F.lit(fixed).cast("double"))
        masks.append(F.when(F.col(name).isNull(), False).otherwise(F.col(value) < F.col(name) if sign < 0 else F.col(value) > F.col(name)))
    return out.withColumn("outlier", masks[0] | masks[1]).drop("_lo", "_hi")


def zscore_outliers(df: DataFrame, keys: list[str], threshold: float, window: str | None = None, step: str = "PT1H", centre: str = "mean", time: str = "time", value: str = "value") -> DataFrame:
    """Add ``outlier``: |z| of at least ``threshold``, over the series or a trailing window of rows.

    z is less the mean (or ``centre`` 'median' without a window), over the sample deviation; the
    first row of a window gets the second's. A deviation of zero or NULL values give NULL.
    """
    require(df, time, value, *keys)
    v = F.col(value)
    if window is None:
        # Aggregated before it moves: a series is one row of the join's other side.
        one = df.groupBy(*keys).agg((F.avg(v) if centre == "mean" else F.median(v)).alias("_mid"), F.stddev_samp(v).alias("_sd"))
        one = one.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_mid", "_sd")
        joined = df.join(one, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
        return joined.withColumn("outlier", F.abs(F.try_divide(v - F.col("_mid"), F.col("_sd"))) >= threshold).select(*df.columns, "outlier")
    else:
        n = max(1, seconds(window) // seconds(step))
        own, w = df.columns, rows_of().rowsBetween(-(n - 1), 0)
        rows = row_blocks(df, keys, time, n).withColumn("_z", F.try_divide(v - F.avg(v).over(w), F.stddev_samp(v).over(w)))
        z = F.when(F.col("_r") == 0, F.lead("_z").over(rows_of())).otherwise(F.col("_z"))
        return rows.withColumn("outlier", F.abs(z) >= threshold).where("_mine").select(*own, "outlier")


def profiled_days(df: DataFrame, keys: list[str], tz: str, time: str = "time", value: str = "value") -> DataFrame:
    """(keys..., date, profiled): days with the very profile of the day 1, 3 or 7 days of data before, and not among the lowest tenth.

    A profile is the hours' share of the day's total to five decimals. For data of at most hourly steps.
    """
    require(df, time, value, *keys)
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), tz)
    hours = df.groupBy(*keys, F.to_date(local).alias("date"), F.hour(local).alias("_h")).agg(F.sum(value).alias("_v"))
    total = F.sum("_v").over(Window.partitionBy(*keys, "date"))
    shares = hours.withColumn("_t", total).withColumn("_p", F.round(F.try_divide(F.col("_v"), F.col("_t")) * 100, 5))
    days = shares.groupBy(*keys, "date").agg(F.array_sort(F.collect_list(F.struct("_h", "_p"))).alias("_k"), F.max("_t").alias("_t"))
    w = Window.partitionBy(*keys).orderBy("date")
    same = F.lit(False)
    for k in (1, 3, 7):
        same = same | F.coalesce(F.lag("_k", k).over(w) == F.col("_k"), F.lit(False))
    return days.withColumn("_q", F.percentile("_t", 0.1).over(Window.partitionBy(*keys))).select(*keys, "date", (same & (F.col("_t") > F.col("_q"))).alias("profiled"))


def calendar_model_outliers(
    df: DataFrame, keys: list[str], features: tuple[str, ...] = ("H", "HOL"), tz: str = "UTC", window: str = "P1Y", lower: float = 10.0, upper: float = 90.0, mode: str = "upperAndLower", margin: float = 30.0, harmonics: int = 3, holidays: list[str] | None = None, log: bool = False, time: str = "time", value: str = "value", window_columns: list[str] | None = None, bad_days: list[str] | None = None, profiled: bool = False
) -> DataFrame:
    """(keys..., time, value, lower, upper, outlier) by quantile regression on calendar features, per series and window.

    Features: H hour, U weekday, W week, m month (each a Fourier series of ``harmonics``), HOL
    weekend or holiday; the design is their product. Bounds are the regressions at the ``lower``
    and ``upper`` percent, widened by ``margin`` percent. A window is one task: choose it bounded.
    Where a fit is impossible the value itself is the prediction. NULL values are no outliers.
    ``window_columns``: the values of these columns tell windows apart instead of time. All values of
    the local days ``bad_days`` (ISO dates), and with ``profiled`` those of profiled_days(), are
    outliers too.
    """
    require(df, time, value, *keys, *(window_columns or []))
    days = set(holidays or [])
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), tz)
    rows = df.select(*keys, F.col(time).cast("timestamp").alias("time"), F.col(value).cast("double").alias("value"), local.alias("_l"), (F.to_json(F.struct(*window_columns)) if window_columns else bucket(F.col(time).cast("timestamp"), window, tz)).alias("_w"), (F.date_format(local, "yyyy-MM-dd").isin(bad_days) if bad_days else F.lit(False)).alias("_bad"))
    if profiled:
        days_ = profiled_days(df, keys, tz, time, value).where("profiled").select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("date").alias("_date"), F.lit(True).alias("_copy"))
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
        rows = rows.join(days_, [*same, F.to_date("_l") == F.col("_date")], "left").withColumn("_bad", F.col("_bad") | F.coalesce("_copy", F.lit(False))).select(*keys, "time", "value", "_l", "_w", "_bad")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf["_l"]
        base = {"H": t.dt.hour / 24, "U": t.dt.dayofweek / 7, "W": t.dt.strftime("%U").astype(float) / 53, "m": (t.dt.month - 1) / 12}
        x = np.ones((len(pdf), 1))
        for f in features:
            if f == "HOL":
                off = ((t.dt.dayofweek >= 5) | t.dt.strftime("%Y-%m-%d").isin(days)).to_numpy()
                cols = np.stack([~off, off], 1).astype(float)
            else:
                a = 2 * np.pi * base[f].to_numpy()[:, None] * np.arange(1, harmonics + 1)
                cols = np.concatenate([np.ones((len(pdf), 1)), np.sin(a), np.cos(a)], axis=1)
            x = (x[:, :, None] * cols[:, None, :]).reshape(len(pdf), -1)
        y = pdf["value"].to_numpy(dtype=float)
        y = np.log(np.maximum(y, 0) + 1) if log else y
        ok = np.isfinite(y)
        bounds = []
        for q in (lower, upper):
            try:
                p = x @ quantile_regression(x[ok], y[ok], q / 100) if ok.sum() > x.shape[1] else y
            except np.linalg.LinAlgError:
                p = y
            bounds.append(np.exp(p) - 1 if log else p)
        lo = np.maximum(0, np.floor(bounds[0])) * (1 - margin / 100)
        hi = np.maximum(0, np.ceil(bounds[1])) * (1 + margin / 100)
        v = pdf["value"].to_numpy(dtype=float)
        with np.errstate(invalid="ignore"):
            under, over = v < lo, v > hi
        bad = {"lower": under, "upper": over, "upperAndLower": under | over}[mode]
        return pdf[[*keys, "time", "value"]].assign(lower=lo, upper=hi, outlier=(bad | pdf["_bad"].to_numpy(dtype=bool)) & ok)

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return rows.where("time IS NOT NULL").groupBy(*keys, "_w").applyInPandas(fit, f"{schema}, time timestamp, value double, lower double, upper double, outlier boolean")


def low_days(df: DataFrame, keys: list[str], tz: str, ignore: list[str] | None = None, time: str = "time", value: str = "value") -> DataFrame:
    """(keys..., date, value, limit, low): days at or below the consumption of the building's quietest weekday.

    Daily totals are the mean times 24. Per weekday the running maximum of 90 days of data, centred;
    the limit is the smallest over weekdays if the largest is over half as much again, else 0.
    """
    require(df, time, value, *keys)
    date = F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), tz))
    days = df.groupBy(*keys, date.alias("date")).agg((F.avg(value) * 24).alias("value"))
    w = Window.partitionBy(*keys).orderBy("date")
    tops = [F.max(F.when(F.weekday("date") == d, F.col("value"))).over(w.rowsBetween(-44, 45)) for d in range(7)]
    days = days.withColumns({f"_m{d}": c for d, c in enumerate(tops)})
    days = days.withColumns({f"_m{d}": F.last(f"_m{d}", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)) for d in range(7)})
    lo, hi = F.least(*[f"_m{d}" for d in range(7)]), F.greatest(*[f"_m{d}" for d in range(7)])
    limit = F.when(F.try_divide(hi - lo, lo) > 0.5, lo).otherwise(0.0)
    skip = F.date_format("date", "yyyy-MM-dd").isin(ignore) if ignore else F.lit(False)
    return days.select(*keys, "date", "value", limit.alias("limit"), ((F.col("value") <= limit) & ~skip).alias("low"))
