"""Daily load curves: matrix, clustering, classification and change points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridlake.functions.numerics import density_valleys, eigengap, quantile_regression, spectral_clusters, spline_slope, whole_day
from gridlake.functions.period import seconds
from gridlake.runtime import cut, require


def load_curve_matrix(df: DataFrame, keys: list[str], tz: str, parts: int = 24, relative: bool = True, time: str = "time", value: str = "value") -> DataFrame:
    """(keys..., date, part_00...): the local day's sums per part of the day, as shares of the day if ``relative``. Parts without rows are NULL."""
    require(df, time, value, *keys)
    local = F.from_utc_timestamp(F.col(time).cast("timestamp"), tz)
    part = F.floor(F.hour(local) / (24 / parts))
    total = F.sum(value)
    cols = [F.sum(F.when(part == k, F.col(value))) for k in range(parts)]
    cols = [F.try_divide(c, total) if relative else c for c in cols]
    return df.groupBy(*keys, F.to_date(local).alias("date")).agg(*[c.alias(f"part_{k:02d}") for k, c in enumerate(cols)])


def nearest_centroid(days: DataFrame, centres: DataFrame, columns: list[str], label: str, most_missing: int = 0) -> DataFrame:
    """Add ``label`` and ``distance`` of the nearest centre; NULL with over ``most_missing`` NULL columns. Ties by label.

    The centres are packed into one row of arrays; there are as many as kinds of day.
    """
    packed = centres.agg(F.collect_list(F.struct(F.col(label).alias("s"), F.array(*columns).alias("c"))).alias("_centres"))
    x = F.array(*columns)
    square = lambda a, b: F.coalesce((a - b) * (a - b), F.lit(0.0))
    dist = lambda c: F.sqrt(F.aggregate(F.zip_with(x, c["c"], square), F.lit(0.0), lambda acc, v: acc + v))
    best = F.array_min(F.transform("_centres", lambda c: F.struct(dist(c).alias("d"), c["s"].alias("s"))))
    missing = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    got = days.crossJoin(F.broadcast(packed)).withColumn("_b", F.when(missing <= most_missing, best))
    return got.select(*days.columns, F.col("_b.s").alias(label), F.col("_b.d").alias("distance"))


def similarity(x: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """exp(-alpha * Euclidean distance) of all pairs of rows, 0 on the diagonal."""
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (x**2).sum(1)[None] - 2 * x @ x.T, 0))
    s = np.exp(-alpha * d)
    np.fill_diagonal(s, 0)
    return s


def affinity(s: np.ndarray, n: int = 2) -> np.ndarray:
    """Only the n largest of each row (all ties), symmetric."""
    if n >= len(s):
        return s
    least = -np.sort(-s, axis=1)[:, n - 1]
    keep = s >= least[:, None]
    return np.where(keep | keep.T, s, 0.0)


def day_kinds(y: np.ndarray, neighbours: int, k_min: int, k_max: int) -> np.ndarray:
    """Spectral cluster of each row: nearest-neighbour affinity, as many clusters as the largest gap of the Laplacian's eigenvalues says."""
    a = affinity(similarity(y, 10.0), neighbours)
    return spectral_clusters(a, min(eigengap(a, k_min, k_max), len(y) - 1))


def joined_centres(c: np.ndarray, n: np.ndarray, copies: int, neighbours: int, k_min: int, k_max: int, block: int) -> np.ndarray:
    """Centres of the clusters of centres ``c``, which stand for ``n`` days each; about ``copies`` of them for each kind of day."""
    while len(c) > block:  # as for days: by blocks, whose centres are clustered again
        parts = np.array_split(np.arange(len(c)), -(-len(c) // block))
        label = np.concatenate([k * (k_max + 1) + day_kinds(c[p], neighbours, k_min, k_max) for k, p in enumerate(parts)])
        c, n = _centres(c, n, label)
        copies = len(parts)
    return _centres(c, n, day_kinds(c, min(neighbours, max(2, copies - 1)), k_min, k_max))[0]


def _centres(c: np.ndarray, n: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    kinds = [label == k for k in np.unique(label)]
    return np.stack([np.average(c[k], axis=0, weights=n[k]) for k in kinds]), np.array([n[k].sum() for k in kinds])


def cluster_days(df: DataFrame, group: str, id_column: str, curve: str, neighbours: int = 7, k_min: int = 2, k_max: int = 10, block: int = 512, features: int | None = None) -> DataFrame:
    """(group, id_column, block, cluster): spectral clusters of each building's daily curves.

    Similarity, nearest-neighbour affinity, the number of clusters at the largest gap of the
    Laplacian's eigenvalues, spectral clustering. Days of 23 or 25 hours and NULL hours are brought
    to 24 hours. The eigenproblem is cubic in its days, so a building with over ``block`` days is
    clustered by blocks; the blocks' centres are clustered once more, and each day takes the nearest
    of the centres so found: a label means the same in all blocks of a building. With ``features``
    the arrays hold so many scaled features of a day instead, and are taken as they are.
    """
    require(df, group, id_column, curve)
    kind, gkind = df.schema[id_column].dataType.simpleString(), df.schema[group].dataType.simpleString()
    size = df.groupBy(group).agg(F.ceil(F.count("*") / block).alias("_n"))
    rows = df.join(size, group).withColumn("block", F.pmod(F.xxhash64(id_column), F.col("_n")).cast("int"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if features is None:
            x = np.array([whole_day(c) for c in pdf[curve]])
            ok = np.isfinite(x).all(1) & (np.nan_to_num(x).sum(1) != 0)
        else:
            x = np.array([np.full(features, np.nan) if c is None else np.array(c, float) for c in pdf[curve]]).reshape(-1, features)
            ok = np.isfinite(x).all(1)
        label = pd.Series([None] * len(pdf), dtype=object)
        shape = pd.Series([None] * len(pdf), dtype=object)
        y = x[ok] if features is not None else x[ok] / x[ok].sum(1, keepdims=True)
        one = pdf["_n"].iloc[0] == 1
        if ok.sum() > k_min + 1:
            label[np.flatnonzero(ok)] = [f"{v + 1:02d}" for v in day_kinds(y, neighbours, k_min, k_max)]
        elif not one:  # too few to cluster here: each is a centre of its own
            label[np.flatnonzero(ok)] = [f"{v + 1:02d}" for v in range(len(y))]
        if not one:
            shape[np.flatnonzero(ok)] = list(y)
        return pd.DataFrame({group: pdf[group], id_column: pdf[id_column], "block": pdf["block"], "cluster": label.to_numpy(), "_n": pdf["_n"], "_shape": shape.to_numpy()})

    schema = f"`{group}` {gkind}, `{id_column}` {kind}, block int, cluster string"
    got = cut(rows.groupBy(group, "block").applyInPandas(run, f"{schema}, _n bigint, _shape array<double>"))
    mean = F.array(*[F.avg(F.element_at("_shape", k + 1)) for k in range(features or 24)])
    parts = got.where("_shape IS NOT NULL").groupBy(group, "block", "cluster", "_n").agg(mean.alias("_c"), F.count("*").cast("double").alias("_days"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["block", "cluster"])
        if len(pdf) <= k_min + 1:
            return pd.DataFrame({group: pdf[group].iloc[:0], "_centres": pd.Series([], dtype=object)})
        c = joined_centres(np.stack(pdf["_c"].to_list()), pdf["_days"].to_numpy(), int(pdf["_n"].iloc[0]), neighbours, k_min, k_max, block)
        return pd.DataFrame({group: pdf[group].iloc[:1], "_centres": [[v.tolist() for v in c]]})

    centres = parts.groupBy(group).applyInPandas(join, f"`{group}` {gkind}, _centres array<array<double>>")
    far = lambda c: F.aggregate(F.zip_with("_shape", c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, v: acc + v)
    best = F.array_min(F.transform("_centres", lambda c, i: F.struct(far(c).alias("d"), (i + 1).alias("k"))))["k"]
    name = F.when(F.col("_n") == 1, F.col("cluster")).when(F.col("_shape").isNotNull(), F.lpad(best.cast("string"), 2, "0"))
    return got.join(centres, group, "left").select(group, id_column, "block", name.alias("cluster"))


def day_features(df: DataFrame, keys: list[str], tz: str, parts: int = 24, step: str = "PT1H", relative: bool = True, holidays: list[str] | None = None, bases: list[float] | None = None, time: str = "time", value: str = "value", temperature: str = "temperature") -> DataFrame:
    """(keys..., date, weekday, isWeekend, isHolidays, month, consumption, minConsumption, maxConsumption, temperature, part_00..., hdd/cdd{base}): features of local days.

    Of repeated hours the one that comes first counts. consumption is the hours' mean times their
    number a day. A part is the mean of its hours, as a share of the parts' sum if ``relative``; NULL
    without rows. Degrees count from two beyond each base.
    """
    require(df, time, value, temperature, *keys)
    t = F.col(time).cast("timestamp")
    local = F.from_utc_timestamp(t, tz)
    hours = df.where(t.isNotNull()).groupBy(*keys, F.to_date(local).alias("date"), F.hour(local).alias("_h")).agg(F.min(F.struct(t.alias("t"), F.col(value).cast("double").alias("v"), F.col(temperature).cast("double").alias("w"))).alias("_x"))
    part = F.floor(F.col("_h") / (24 / parts))
    v, w = F.col("_x.v"), F.col("_x.w")
    means = [F.avg(F.when(part == k, v)).alias(f"part_{k:02d}") for k in range(parts)]
    names = [f"part_{k:02d}" for k in range(parts)]
    days = hours.groupBy(*keys, "date").agg((F.avg(v) * (86400 // seconds(step))).alias("consumption"), F.min(v).alias("minConsumption"), F.max(v).alias("maxConsumption"), F.avg(w).alias("temperature"), *means)
    total = sum((F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0))
    off = F.date_format("date", "yyyy-MM-dd").isin(holidays) if holidays else F.lit(False)
    weekday = F.weekday("date") + 1
    degrees = {f"{m}dd{b:g}": F.greatest((b - 2) - F.col("temperature") if m == "h" else F.col("temperature") - (b + 2), F.lit(0.0)) for b in bases or [] for m in "hc"}
    degrees = {n: F.when(F.col("temperature").isNotNull(), c) for n, c in degrees.items()}
    return days.select(
        *keys, "date", weekday.alias("weekday"), (weekday >= 6).alias("isWeekend"), off.alias("isHolidays"), F.month("date").alias("month"),
        "consumption", "minConsumption", "maxConsumption", "temperature", *[(F.try_divide(F.col(n), total) if relative else F.col(n)).alias(n) for n in names], *[c.alias(n) for n, c in degrees.items()],
    )


QUANTILES = [5, 10, 20, 30, 40, 50, 60, 80, 90, 95]  # percent, of the curves of consumption against temperature


def day_signatures(days: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """day_features() with tbal, baseload, residualsGAM{q}, hddX, cddX, slopeHdd, slopeCdd and residual per series.

    Consumption against temperature is a spline at each of QUANTILES; residualsGAM is a day's distance
    from it, relative. tbal is the mean temperature where the median curve is in its lowest fifth,
    within the 20th and 80th percentile; degrees count from two beyond it. The slopes are those of the
    upper quartile's regression on the degrees, 0 at least; residual is the day's consumption less its
    fit, relative. NULL for series with fewer than ``least`` complete days. A series comes as one row a
    day.
    """
    names = ["tbal", "baseload", *[f"residualsGAM{q}" for q in QUANTILES], "hddX", "cddX", "slopeHdd", "slopeCdd", "residual"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        y, t = pdf["consumption"].to_numpy(dtype=float), pdf["temperature"].to_numpy(dtype=float)
        ok = np.isfinite(y) & np.isfinite(t)
        out = {n: np.full(len(pdf), np.nan) for n in names}
        if ok.sum() >= least and np.ptp(t[ok]) > 0:
            lo, hi = np.quantile(t[ok], [0.2, 0.8])
            knots = np.quantile(t[ok], [0.25, 0.5, 0.75])
            z = lambda x: (x - t[ok].mean()) / max(t[ok].std(), 1e-9)
            basis = lambda x: np.column_stack([np.ones(len(x)), z(x), *[np.maximum(z(x) - z(k), 0) for k in knots]])
            for q in QUANTILES:
                beta = quantile_regression(basis(t[ok]), y[ok], q / 100)
                fit = basis(t) @ beta
                out[f"residualsGAM{q}"] = np.where(np.abs(fit) > 1e-9, (y - fit) / fit, np.nan)
                if q == 50:
                    inside = fit[ok]
                    tbal = float(np.clip(t[ok][inside <= np.quantile(inside, 0.2)].mean(), lo, hi))
                    out["tbal"][:], out["baseload"][:] = tbal, float((basis(np.array([tbal])) @ beta)[0])
            h, c = np.maximum(tbal - 2 - t, 0), np.maximum(t - tbal - 2, 0)
            x = np.column_stack([np.ones(len(t)), h, c])
            used = np.array([True, (h[ok] > 0).any(), (c[ok] > 0).any()])
            beta = np.zeros(3)
            beta[used] = quantile_regression(x[ok][:, used], y[ok], 0.75)
            out["hddX"], out["cddX"] = h, c
            out["slopeHdd"][:], out["slopeCdd"][:] = max(beta[1], 0.0), max(beta[2], 0.0)
            out["residual"] = (x @ beta - y) / np.where(y > 0, y, 1.0)
        return pdf.assign(**out)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in days.schema.fields)
    return days.groupBy(*keys).applyInPandas(run, schema + "".join(f", {n} double" for n in names))


def scale_features(days: DataFrame, keys: list[str], inputs: list[str], method: str = "range01", scaling: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(keys..., date, inputs... scaled per series) and the scaling, a row per series, for later days.

    'range01': NULLs become the series' mean, the range 0 to 1, constants 0. 'znorm': less the mean
    over the deviation, NULLs stay and so do features without deviation.
    """
    require(days, "date", *keys, *inputs)
    x = {c: F.col(c).cast("double") for c in inputs}
    if scaling is None:
        stats = {"lo": F.min, "hi": F.max, "mean": F.avg, "sd": F.stddev_samp}
        scaling = cut(days.groupBy(*keys).agg(*[f(x[c]).alias(f"{c}_{n}") for c in inputs for n, f in stats.items()]))
    joined = days.select(*keys, "date", *[x[c].alias(c) for c in inputs]).join(scaling, keys)
    of = lambda c, n: F.col(f"{c}_{n}")
    ranged = lambda c: F.coalesce(F.try_divide(F.coalesce(F.col(c), of(c, "mean")) - of(c, "lo"), of(c, "hi") - of(c, "lo")), F.when(of(c, "mean").isNotNull(), 0.0))
    scored = lambda c: F.try_divide(F.col(c) - of(c, "mean"), of(c, "sd"))
    return joined.select(*keys, "date", *[(ranged(c) if method == "range01" else scored(c)).alias(c) for c in inputs]), scaling


def cluster_features(days: DataFrame, key: str, inputs: list[str], ignore: list[str] | None = None, **limits: int) -> tuple[DataFrame, DataFrame]:
    """(key, date, inputs..., cluster) of scaled days, and the centres (key, cluster, days, inputs...) by which classify later days.

    Days in ``ignore`` (ISO dates) or with a NULL get no cluster. See cluster_days() for ``limits``.
    """
    require(days, key, "date", *inputs)
    use = days.where(~F.date_format("date", "yyyy-MM-dd").isin(ignore)) if ignore else days
    packed = use.select(key, "date", F.array(*inputs).alias("_curve"))
    got = cluster_days(packed, key, "date", "_curve", features=len(inputs), **limits).select(key, "date", "cluster")
    out = cut(days.select(key, "date", *inputs).join(got, [key, "date"], "left"))
    return out, out.where("cluster IS NOT NULL").groupBy(key, "cluster").agg(F.count("*").alias("days"), *[F.avg(c).alias(c) for c in inputs])


def change_points(df: DataFrame, keys: list[str], tz: str, temperature: str = "temperature", value: str = "value", time: str = "time", points: int = 40) -> DataFrame:
    """(keys..., tbalh, tbalc, heating, cooling): temperatures below and above which the daily consumption depends on the weather.

    A penalised spline of daily consumption on daily mean temperature; where its slope is surely
    negative (95 %, and a tenth of the steepest) for three or more grid points that begin up to 16
    degrees there is heating, tbalh is the run's upper end; likewise positive, to 20 degrees or over, for cooling. Each group's daily means are one task.
    """
    require(df, time, value, temperature, *keys)
    day = F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), tz))
    days = df.groupBy(*keys, day.alias("date")).agg((F.avg(value) * 24).alias("v"), F.avg(temperature).alias("t"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = {k: [pdf[k].iloc[0]] for k in keys} | {"tbalh": [np.nan], "tbalc": [np.nan], "heating": [False], "cooling": [False]}
        ok = np.isfinite(pdf.v) & np.isfinite(pdf.t)
        t, v = pdf.t[ok].to_numpy(), pdf.v[ok].to_numpy()
        if ok.sum() >= 20 and np.ptp(t) > 1:
            at = np.linspace(t.min(), t.max(), points)
            _, slope, se = spline_slope(t, v, at)
            least = np.maximum(1.96 * se, 0.1 * np.max(np.abs(slope)))
            for sign, name in ((-1, "h"), (1, "c")):
                sure = slope * sign > least
                edge = np.flatnonzero(np.diff(np.concatenate([[0], sure.astype(int), [0]])))
                for a, b in zip(edge[::2], edge[1::2], strict=True):
                    if b - a >= 3 and (at[a] <= 16 if name == "h" else at[b - 1] >= 20):
                        out["heating" if name == "h" else "cooling"] = [True]
                        if name == "h":
                            out["tbalh"] = [round(float(np.nanmax([out["tbalh"][0], at[b - 1]])), 2)]
                        else:
                            out["tbalc"] = [round(float(np.nanmin([out["tbalc"][0], at[a]])), 2)]
        return pd.DataFrame(out)

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return days.groupBy(*keys).applyInPandas(run, f"{schema}, tbalh double, tbalc double, heating boolean, cooling boolean")


def consumption_levels(df: DataFrame, keys: list[str], value: str = "value", bins: int = 512) -> DataFrame:
    """(keys..., level, above): where the density of a group's values has valleys, level 0 beginning at its minimum.

    The values are counted in ``bins`` of equal width between the group's extremes before the
    density is estimated, so a group may have any number of rows.
    """
    require(df, value, *keys)
    v = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull() & ~F.isnan("_v"))
    ends = v.groupBy(*keys).agg(F.min("_v").alias("_a"), F.max("_v").alias("_z"))
    mid = F.col("_a") + (F.floor(F.least(F.coalesce(F.try_divide(F.col("_v") - F.col("_a"), F.col("_z") - F.col("_a")), F.lit(0.0)) * bins, F.lit(bins - 1.0))) + 0.5) * (F.col("_z") - F.col("_a")) / bins
    counts = v.join(ends, keys).groupBy(*keys, mid.alias("_m")).agg(F.count("*").alias("_n"), F.min("_a").alias("_a"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = pdf["_n"].to_numpy()
        # A thousand values in the same proportions give the same density.
        sample = np.repeat(pdf["_m"].to_numpy(), np.maximum(1, np.round(n * 1000 / n.sum()).astype(int)))
        above = [pdf["_a"].iloc[0], *density_valleys(sample, 1.0)]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] * len(above) for k in keys}, "level": range(len(above)), "above": above})

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return counts.groupBy(*keys).applyInPandas(run, f"{schema}, level int, above double")


def calendar_classifier(days: DataFrame, label: str, date: str = "date", trees: int = 50, seed: int = 1):  # noqa: ANN201
    """A random forest that tells a day's kind from its month, day of the year and weekday; transform() adds ``predicted``."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexer, VectorAssembler

    calendar = SQLTransformer(statement=f"SELECT *, CAST(month({date}) AS DOUBLE) AS _month, CAST(dayofyear({date}) AS DOUBLE) AS _day, CAST(weekday({date}) AS DOUBLE) AS _weekday FROM __THIS__")
    known = days.where(F.col(label).isNotNull() & F.col(date).isNotNull())
    index = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(known)
    vector = VectorAssembler(inputCols=["_month", "_day", "_weekday"], outputCol="_features")
    forest = RandomForestClassifier(numTrees=trees, seed=seed, labelCol="_label", featuresCol="_features", predictionCol="_predicted", probabilityCol="_p", rawPredictionCol="_raw")
    names = IndexToString(inputCol="_predicted", outputCol="predicted", labels=index.labels)
    model = Pipeline(stages=[calendar, vector, forest, names])
    return model.fit(index.transform(known))


def classify_days(days: DataFrame, centres: DataFrame, columns: list[str], label: str, classifier, date: str = "date") -> DataFrame:  # noqa: ANN001
    """Add ``label``: the nearest centre's, or by the calendar where a day's curve is incomplete; ``by`` tells which."""
    near = nearest_centroid(days, centres, columns, label)
    got = classifier.transform(near)
    return got.select(*days.columns, F.coalesce(label, "predicted").alias(label), F.when(F.col(label).isNotNull(), "curve").otherwise("calendar").alias("by"))


def vote_days(days: DataFrame, features: DataFrame, inputs: list[str], curves: DataFrame, hours: list[str], label: str, classifier=None, normal: str = "features", abnormal: str = "curves", most_missing: int = 1) -> DataFrame:  # noqa: ANN001
    """days with ``label``, ``abnormal`` and the votes by_features, by_curves and by_calendar.

    Votes: the nearest centre by the inputs, by the hours, and the calendar classifier's (NULL without
    one). A day that lacks an input is abnormal. A distance may lack ``most_missing`` terms, else its
    vote is NULL. The label is the vote named by ``normal`` or ``abnormal``: 'features', 'curves',
    'calendar'.
    """
    require(days, *inputs, *hours)
    got = nearest_centroid(days, features, inputs, label, most_missing).withColumnRenamed(label, "by_features").drop("distance")
    got = nearest_centroid(got, curves, hours, label, most_missing).withColumnRenamed(label, "by_curves").drop("distance")
    got = classifier.transform(got).withColumnRenamed("predicted", "by_calendar") if classifier else got.withColumn("by_calendar", F.lit(None).cast("string"))
    lacks = F.lit(False)
    for c in inputs:
        lacks = lacks | F.col(c).isNull()
    return got.select(*days.columns, "by_features", "by_curves", "by_calendar", lacks.alias("abnormal"), F.when(lacks, F.col(f"by_{abnormal}")).otherwise(F.col(f"by_{normal}")).alias(label))
