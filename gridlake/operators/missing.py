"""Missing values: which cells hold no measurement, and chained-equation imputation."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from gridlake.runtime import BROADCAST_GROUPS, cut, require, sorted_groups

# Numbers that loggers put in place of a missing measurement.
PLACEHOLDER_NUMBERS = [-999.0, -999.9, -9999.0, -99999.0, 9999.0, 99999.0]
# Words, in lower case, put in place of a missing category.
PLACEHOLDER_WORDS = ["", "-", "--", "?", "na", "n/a", "n/d", "nd", "nan", "none", "null", "unknown", "undefined", "missing", "tbd"]


def no_number(c: Column) -> Column:
    """TRUE where there is nothing, not a number, or a placeholder number; never NULL."""
    return F.coalesce(F.isnan(c) | c.isin(PLACEHOLDER_NUMBERS), F.lit(True))


def no_category(c: Column) -> Column:
    """TRUE where there is nothing or a placeholder word; never NULL."""
    return F.coalesce(F.lower(F.trim(c)).isin(PLACEHOLDER_WORDS), F.lit(True))


def impute_chained(
    df: DataFrame,
    id_column: str = "reading_id",
    source: str = "sensorid",
    group: str = "buildingsubject",
    time: str = "reading_ts",
    fields: tuple[str, str] = ("qe", "temperature"),
    category: str = "usetype",
    plausible: tuple[tuple[float, float], tuple[float, float]] = ((0.0, 1e12), (-60.0, 60.0)),
    rounds: int = 20,
    chunk_days: int = 56,
    margin_days: int = 7,
    residual: bool = True,
) -> DataFrame:
    """Fill two numeric fields and a category by chained equations; mark every filled cell.

    Returns id_column, then for each field f: f (as it was where it held a measurement, else the
    filled value) and f_filled. Nothing else of the input is returned; join on the id for more.

    * Similar records: values of the same source, in blocks of ``chunk_days`` seen with ``margin_days``
      before and after, standardised by their mean and spread; predictors of a field are the other
      field, the observed readings before and after, the other days' mean at the same hour, and the
      hour itself.
    * The regressions of each field on the rest are fitted in turn until ``rounds`` are done. One
      distributed pass reduces the rows to cross-products per missingness pattern (four small
      matrices); the chained fits then update these, which gives the same coefficients as refitting
      over all rows, and no further pass. The category is constant or nearly so within a source, so
      among standardised predictors it has no place.
    * A filled value gets a residual drawn from the fit's spread, reproducibly from the id, so
      the variation of filled values resembles the measured one (``residual=False``: the mean).
    * The category comes last in the chain, from a classifier of the numeric fields as filled: naive
      Bayes with normal densities per category fitted to all rows, and the counts of categories in the
      source's block as prior. A block without any takes its group's commonest category, else the
      commonest of all; ties go to the alphabetically first. More than BROADCAST_GROUPS categories
      are an error.
    * Implausible values (outside ``plausible``) stay as they are and take no part in the fits.

    NULL sources form one source, NULL times one block of each source. If a source's block holds no
    value of a field, the group's mean, else the overall mean is filled; if there is none at all the
    cell stays NULL and is not marked. An empty table gives an empty result. Repeated ids are rows of
    their own.
    """
    require(df, id_column, source, group, time, category, *fields)
    a, b = fields
    base = df.select(
        F.col(id_column).alias("_id"), F.coalesce(F.col(source).cast("string"), F.lit("\u0000")).alias("_s"), F.col(group).alias("_g"), F.unix_seconds(F.col(time).cast("timestamp")).alias("_t"),
        F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"), F.col(category).cast("string").alias("u"),
    ).withColumns({"mu": no_category(F.col("u"))})
    # The first field spans orders of magnitude and has a floor of zero: work on its square root.
    for f, change, (lo, hi) in zip("ab", (F.sqrt, lambda c: c), plausible, strict=True):
        base = base.withColumn("k" + f, change(F.when(~no_number(F.col(f)) & F.col(f).between(lo, hi), F.col(f))))
    level = _levels(base)
    densities = level["category"].where("u IS NOT NULL")
    if densities.count() > BROADCAST_GROUPS:
        raise ValueError(f"{category} has more than {BROADCAST_GROUPS} values")
    density = {r["u"]: tuple(r[1:]) for r in densities.collect()}  # five numbers each
    lacks = no_number(F.col("a")) | no_number(F.col("b")) | F.col("mu")
    day = 86400
    first, last = (F.floor((F.col("_t") + sign * margin_days * day) / (chunk_days * day)) for sign in (-1, 1))
    rows = base.select(
        "_id", "_s", F.col("_g"), F.coalesce("_t", F.lit(0)).alias("_t"), "a", "b", F.when(~F.col("mu"), F.col("u")).alias("u"), F.when(lacks, F.shiftrightunsigned(F.xxhash64("_id"), 11)).alias("_x"),
        F.explode(F.coalesce(F.sequence(first, last), F.array(F.lit(NO_TIME).cast("bigint")))).alias("_c"),
    )
    kinds = {"_id": df.schema[id_column].dataType.simpleString(), "_g": df.schema[group].dataType.simpleString()}
    chunk = chunk_days * day

    def sums(pdf: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
        x = _block_terms(pdf, begin, chunk, plausible)
        full = np.column_stack([np.nan_to_num(x[n]) for n in TERMS])
        out = []
        for na in (False, True):
            for nb in (False, True):
                m = full[x["mine"] & (np.isnan(x["za"]) == na) & (np.isnan(x["zb"]) == nb)]
                out.append({"na": na, "nb": nb, "gram": (m.T @ m).ravel().tolist()})
        return pd.DataFrame(out)

    parts = sorted_groups(rows, ["_s", "_c"], ["_t", "_id"], sums, "na boolean, nb boolean, gram array<double>")
    d = len(TERMS)
    total = parts.groupBy("na", "nb").agg(*[F.sum(F.col("gram")[i * d + j]).alias(f"s{i}_{j}") for i in range(d) for j in range(i, d)]).collect()  # four rows
    beta = _chained_fit(total, rounds)

    def fill(pdf: pd.DataFrame, begin: np.ndarray) -> pd.DataFrame:
        x = _block_terms(pdf, begin, chunk, plausible)
        dot = lambda names, w: sum(np.nan_to_num(x[n]) * v for n, v in zip(names, w, strict=True))
        complete = TERMS[2:]
        est = {
            "a": np.where(np.isnan(x["zb"]), dot(complete, beta["both_a"]), dot(["zb", *complete], beta["a"])),
            "b": np.where(np.isnan(x["za"]), dot(complete, beta["both_b"]), dot(["za", *complete], beta["b"])),
        }
        out = {"_id": pdf["_id"], "_g": pdf["_g"]}
        for i, f in enumerate("ab"):
            noise = _normal(pdf["_x"].to_numpy(), i) * float(beta["s" + f]) if residual else 0.0
            out["m" + f] = x["m" + f]
            out[f] = np.where(x["m" + f], (est[f] + noise) * np.nan_to_num(x["sd" + f]) + x["mean" + f], pdf[f].to_numpy(dtype=float))
            x["filled" + f] = np.where(np.isnan(x["k" + f]), x["mean" + f] + est[f] * np.nan_to_num(x["sd" + f]), x["k" + f])
        out["mu"] = pdf["u"].isna().to_numpy()
        out["u"] = _classify(pdf["u"].to_numpy(), x["group"], x["filleda"], x["filledb"], density)
        return pd.DataFrame(out)[x["mine"]]

    filled = sorted_groups(rows, ["_s", "_c"], ["_t", "_id"], fill, f"_id {kinds['_id']}, _g {kinds['_g']}, ma boolean, a double, mb boolean, b double, mu boolean, u string")
    groups = cut(level["group"])
    # A row per group: sent to all tasks only up to a size, else joined by a shuffle.
    x = filled.join(F.broadcast(groups) if groups.count() <= BROADCAST_GROUPS else groups, "_g", "left").crossJoin(F.broadcast(level["all"]))
    out = {}
    for f, (lo, hi) in zip("ab", plausible, strict=True):
        raw = F.coalesce(F.nanvl(F.col(f), F.lit(None).cast("double")), "g" + f, "t" + f)
        value = F.pow(F.greatest(raw, F.lit(0.0)), 2) if f == "a" else raw
        value = F.when(raw.isNotNull(), F.least(F.greatest(value, F.lit(lo)), F.lit(hi)))  # greatest() would pass over a NULL
        out[f] = F.when(~F.col("m" + f), F.col(f)).otherwise(value)
    kind = F.coalesce("u", "gu", "tu")
    return x.select(
        F.col("_id").alias(id_column),
        out["a"].alias(a), (F.col("ma") & out["a"].isNotNull()).alias(a + "_filled"),
        out["b"].alias(b), (F.col("mb") & out["b"].isNotNull()).alias(b + "_filled"),
        kind.alias(category), (F.col("mu") & kind.isNotNull()).alias(category + "_filled"),
    )


NO_TIME = -(1 << 40)  # the block of rows without a time
TERMS = ["za", "zb", "one", "xa", "ya", "xb", "yb", "sin", "cos"]


def _block_terms(pdf: pd.DataFrame, begin: np.ndarray, chunk: int, plausible: tuple) -> dict[str, np.ndarray]:
    """Masks, known values and standardised predictors of the rows of whole blocks, sorted by time; ``mine`` are the rows no other block holds."""
    n = len(pdf)
    size = np.diff(np.append(begin, n))
    group = np.repeat(np.arange(len(begin)), size)
    t, c = pdf["_t"].to_numpy(), pdf["_c"].to_numpy()
    timed = c != NO_TIME
    hour = np.where(timed, t // 3600 % 24, 24)
    out = {"group": group, "mine": ~timed | (t // chunk == c), "one": np.ones(n)}
    out["sin"], out["cos"] = (np.where(timed, f(hour * (2 * math.pi / 24)), 0.0) for f in (np.sin, np.cos))
    at = np.arange(n)
    low, high = np.repeat(begin, size), np.repeat(begin + size, size)
    key = group * 25 + hour
    for f, (lo, hi) in zip("ab", plausible, strict=True):
        v = pdf[f].to_numpy(dtype=float)
        lacks = np.isnan(v) | np.isin(v, PLACEHOLDER_NUMBERS)
        k = np.where(lacks | (v < lo) | (v > hi), np.nan, v)
        k = np.sqrt(k) if f == "a" else k
        known = np.isfinite(k)
        some = np.maximum(np.bincount(group, known, len(begin)), 0)
        with np.errstate(invalid="ignore", divide="ignore"):
            value = np.where(known, k, 0.0)
            mean = np.bincount(group, value, len(begin)) / np.where(some > 0, some, np.nan)
            sd = np.sqrt(np.bincount(group, np.where(known, (k - mean[group]) ** 2, 0.0), len(begin)) / np.where(some > 0, some, np.nan))
            m, s = mean[group], sd[group]
            z = lambda x, m=m, s=s: np.where(s > 0, (x - m) / s, x * 0)
            before = np.concatenate([[-1], np.maximum.accumulate(np.where(known, at, -1))[:-1]])
            after = np.concatenate([np.minimum.accumulate(np.where(known, at, n)[::-1])[::-1][1:], [n]])
            p = np.where(before >= low, k[np.maximum(before, 0)], np.nan)
            q = np.where(after < high, k[np.minimum(after, n - 1)], np.nan)
            near = np.where(np.isnan(p), q, np.where(np.isnan(q), p, (p + q) / 2))
            count, total = np.bincount(key, known, len(begin) * 25)[key] - known, np.bincount(key, value, len(begin) * 25)[key] - value
            others = np.where(count > 0, total / count, np.nan)
            out |= {"m" + f: lacks, "k" + f: k, "mean" + f: m, "sd" + f: s, "z" + f: z(k), "x" + f: np.nan_to_num(z(near)), "y" + f: np.nan_to_num(z(others))}
    return out


def _classify(u: np.ndarray, group: np.ndarray, a: np.ndarray, b: np.ndarray, density: dict[str, tuple]) -> np.ndarray:
    """u with its NULLs filled: of the categories in the row's block the most probable; None where the block has none."""
    lacks = np.array([x is None or x != x for x in u], bool)
    out = np.where(lacks, None, u).astype(object)
    if not lacks.any() or lacks.all():
        return out
    names, code = np.unique(u[~lacks].astype(str), return_inverse=True)
    pairs, n = np.unique(group[~lacks] * len(names) + code, return_counts=True)
    ask = np.flatnonzero(lacks)
    first, last = np.searchsorted(pairs, group[ask] * len(names)), np.searchsorted(pairs, (group[ask] + 1) * len(names))
    best, which = np.full(len(ask), -np.inf), np.full(len(ask), -1)
    for k in range(int((last - first).max())):  # as many as a block has categories
        row = np.flatnonzero(first + k < last)
        pair = pairs[first[row] + k]
        mean_a, var_a, mean_b, var_b = np.array([density.get(names[c], (None,) * 4) for c in pair % len(names)], float).T[:4]
        with np.errstate(invalid="ignore", divide="ignore"):
            lik = sum(np.nan_to_num(-0.5 * ((x[ask[row]] - m) ** 2 / v + np.log(v)), nan=0.0, posinf=0.0, neginf=0.0) for x, m, v in ((a, mean_a, var_a), (b, mean_b, var_b)))
        score = np.log(n[first[row] + k]) + lik
        better = score > best[row]
        best[row[better]], which[row[better]] = score[better], (pair % len(names))[better]
    out[ask[which >= 0]] = names[which[which >= 0]]
    return out


def _levels(base: DataFrame) -> dict[str, DataFrame]:
    """Means and commonest category per group, and over all rows (one row); densities per category."""
    known = F.when(~F.col("mu"), F.col("u"))
    aggs = lambda p: [F.avg("ka").alias(p + "a"), F.avg("kb").alias(p + "b"), F.mode(known, True).alias(p + "u")]
    return {
        "group": base.where("_g IS NOT NULL").groupBy("_g").agg(*aggs("g")), "all": base.agg(*aggs("t")),
        "category": base.groupBy(known.alias("u")).agg(F.avg("ka"), F.var_pop("ka"), F.avg("kb"), F.var_pop("kb")),
    }


def _normal(key: np.ndarray, salt: int) -> np.ndarray:
    """Standard normal numbers that depend on the keys of 53 bits alone; 0 for NULL keys."""
    given = ~pd.isna(key)
    out = np.zeros(len(key))
    with np.errstate(over="ignore"):
        x = key[given].astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        u = []
        for _ in range(2):
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x = x ^ (x >> np.uint64(31))
            u.append(((x >> np.uint64(11)).astype(float) + 0.5) / (1 << 53))
    out[given] = np.sqrt(-2 * np.log(u[0])) * np.cos(2 * math.pi * u[1])
    return out


def _chained_fit(got: list[Row], rounds: int) -> dict[str, np.ndarray]:
    """Coefficients of both chained regressions from the cross-products of TERMS per missingness pattern (na, nb)."""
    names = TERMS
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    d = len(names)
    gram = {}
    for r in got:
        g = np.zeros((d, d))
        for i, j in pairs:
            g[i, j] = g[j, i] = r[f"s{i}_{j}"] or 0.0
        gram[(r["na"], r["nb"])] = g
    zero = np.zeros((d, d))
    c = list(range(2, d))
    on_a, on_b = [1, *c], [0, *c]
    n_rows = sum(g[2, 2] for g in gram.values())
    beta_a, beta_b, var_a, var_b = np.zeros(d - 1), np.zeros(d - 1), 1.0, 1.0
    both_a, both_b = np.zeros(len(c)), np.zeros(len(c))

    def with_filled(g: np.ndarray, maps: dict[int, np.ndarray], var: dict[int, float]) -> np.ndarray:
        """The pattern's cross-products once column k is the linear map maps[k] of all columns plus noise."""
        t = np.eye(d)
        for k, m in maps.items():
            t[k] = m
        full = t @ g @ t.T
        for k, s in var.items():
            full[k, k] += s * g[2, 2]
        return full

    def spread(cols: list[int], w: np.ndarray) -> np.ndarray:
        m = np.zeros(d)
        m[cols] = w
        return m

    for _ in range(rounds):
        total = gram.get((False, False), zero).copy()
        if (True, False) in gram:
            total += with_filled(gram[(True, False)], {0: spread(on_a, beta_a)}, {0: var_a})
        if (False, True) in gram:
            total += with_filled(gram[(False, True)], {1: spread(on_b, beta_b)}, {1: var_b})
        if (True, True) in gram:
            total += with_filled(gram[(True, True)], {0: spread(c, both_a), 1: spread(c, both_b)}, {0: var_a, 1: var_b})
        ridge = 1e-6 * max(n_rows, 1.0)
        solve = lambda t, on, k: np.linalg.solve(t[np.ix_(on, on)] + ridge * np.eye(len(on)), t[on, k])
        beta_a = solve(total, on_a, 0)
        beta_b = solve(total, on_b, 1)
        resid = lambda t, on, k, w: max(0.0, (t[k, k] - 2 * w @ t[on, k] + w @ t[np.ix_(on, on)] @ w) / max(n_rows, 1.0))
        var_a, var_b = resid(total, on_a, 0, beta_a), resid(total, on_b, 1, beta_b)
        # Where both are missing each is filled from the other's last fill, which is linear in the complete columns.
        both_a, both_b = beta_a[1:] + beta_a[0] * both_b, beta_b[1:] + beta_b[0] * both_a
    return {"a": beta_a, "b": beta_b, "both_a": both_a, "both_b": both_b, "sa": np.sqrt(var_a), "sb": np.sqrt(var_b)}
