"""Trainable models of series: regressions with lags, forests, generalised and recursive least squares."""

from __future__ import annotations

import json
import lzma
import random
from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Interaction, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, RandomForestRegressor
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridlake.functions.numerics import bounded_solution, density, density_valleys, loess, out_of_band_periodogram, recursive_least_squares
from gridlake.functions.period import bucket
from gridlake.operators.blocks import numbered
from gridlake.operators.forest import LEAF, grow
from gridlake.runtime import cut, require


@dataclass(frozen=True)
class Feature:
    """One term of a model: a SQL expression, the categories of a column, or the product of several terms."""

    name: str
    expr: str | None = None
    categories: str | None = None
    factors: tuple[Feature, ...] = ()


def build_features(features: list[Feature], out: str = "features") -> list:
    """Spark ML stages that assemble the features' vector; categories are indexed when fitted and frozen for later data."""
    from pyspark.ml.feature import SQLTransformer

    stages: list = []

    def make(f: Feature) -> str:
        col = f"_f_{f.name}"
        if f.factors:
            parts = [make(p) for p in f.factors]
            stages.append(Interaction(inputCols=parts, outputCol=col))
        elif f.categories:
            stages.append(StringIndexer(inputCol=f.categories, outputCol=f"_i_{f.name}", handleInvalid="keep"))
            stages.append(OneHotEncoder(inputCol=f"_i_{f.name}", outputCol=col, dropLast=False))
        else:
            stages.append(SQLTransformer(statement=f"SELECT *, CAST(({f.expr}) AS DOUBLE) AS {col} FROM __THIS__"))
        return col

    names = [make(f) for f in features]
    return [*stages, VectorAssembler(inputCols=names, outputCol=out, handleInvalid="skip")]


def fit_linear(df: DataFrame, features: list[Feature], target: str, family: str = "gaussian", link: str | None = None) -> PipelineModel:
    """Generalised linear model by distributed reweighted least squares: gaussian, poisson, gamma, binomial, tweedie. An intercept is always fitted."""
    glm = GeneralizedLinearRegression(family=family, labelCol=target, featuresCol="features", fitIntercept=True, maxIter=25, regParam=1e-9, predictionCol="predicted", **({"link": link} if link else {}))
    return Pipeline(stages=[*build_features(features), glm]).fit(df.where(F.col(target).isNotNull()))


def fit_forest(df: DataFrame, features: list[Feature], target: str, trees: int = 500, seed: int = 1) -> PipelineModel:
    """Random forest with at least six rows a leaf and the root of the number of features tried per split.

    Rows that fall into at most ``forest.CELLS`` combinations of bins are drawn and predicted by
    cells; more of them go to Spark's own forest, which visits every row in every tree.
    """
    rows = df.where(F.col(target).isNotNull())
    terms = Pipeline(stages=build_features(features)).fit(rows)
    model = grow(terms.transform(rows), "features", target, trees, seed)
    if model is None:
        rf = RandomForestRegressor(numTrees=trees, featureSubsetStrategy="sqrt", minInstancesPerNode=LEAF, seed=seed, labelCol=target, featuresCol="features", predictionCol="predicted")
        model = rf.fit(terms.transform(rows))
    else:
        model.set(model.predictionCol, "predicted")
    return PipelineModel([*terms.stages, model])


def predict(model: PipelineModel, df: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """df with ``predicted``, kept within the bounds; inner columns are dropped."""
    got = model.transform(df)
    p = F.col("predicted")
    p = p if low is None else F.greatest(p, F.lit(low))
    p = p if high is None else F.least(p, F.lit(high))
    return got.select(*df.columns, p.alias("predicted"))


def _schema(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)


def penalised_linear(df: DataFrame, keys: list[str], inputs: list[str], target: str, positive: list[str] | None = None, ridge: float = 0.0, log: bool = False) -> DataFrame:
    """(keys..., term, coefficient) per group, the terms of ``positive`` kept at 0 or above.

    The rows are reduced to cross-products by one aggregation; the bounded fit needs nothing else,
    so a group may have any number of rows.
    """
    require(df, target, *keys, *inputs)
    cols = [*inputs, target]
    x = {c: F.col(c).cast("double") for c in cols}
    if log:
        x[target] = F.log1p(F.greatest(x[target], F.lit(0.0)))
    pairs = [(i, j) for i in range(len(cols)) for j in range(i, len(cols))]
    sums = df.dropna(subset=cols).groupBy(*keys).agg(*[F.sum(x[cols[i]] * x[cols[j]]).alias(f"s{i}_{j}") for i, j in pairs])
    bound = np.array([c in (positive or []) for c in inputs])

    def run(frames):  # noqa: ANN001, ANN202
        for pdf in frames:
            for _, row in pdf.iterrows():
                g = np.zeros((len(cols), len(cols)))
                for i, j in pairs:
                    g[i, j] = g[j, i] = row[f"s{i}_{j}"]
                beta = bounded_solution(g[:-1, :-1] + ridge * np.eye(len(inputs)), g[:-1, -1], bound)
                yield pd.DataFrame({**{k: [row[k]] * len(inputs) for k in keys}, "term": inputs, "coefficient": beta})

    return sums.mapInPandas(run, f"{_schema(df, keys)}, term string, coefficient double")


def autoregressive(df: DataFrame, keys: list[str], inputs: list[str], target: str, lags: list[int], horizon: int, time: str = "time", low: float | None = None, boxcox: float | None = None, status: str | None = None) -> DataFrame:
    """(keys..., time, predicted): each series' last ``horizon`` rows, predicted one after the other from its own predictions.

    Ordinary least squares on the inputs, the target's lags and a constant, fitted to the rows
    before. ``boxcox``: the target, plus 0.001, is fitted and recurs in the transformation of this
    lambda. ``status``: a column for each of whose values the inputs have their own coefficients.
    Recursion follows the series' order, so a series is one task. NULL without enough rows.
    """
    require(df, time, target, *keys, *inputs, *([status] if status else []))

    def there(y: np.ndarray) -> np.ndarray:
        if boxcox is None:
            return y
        y = np.where(y + 0.001 > 0, y + 0.001, np.nan)
        return np.log(y) if abs(boxcox) < 1e-9 else (y**boxcox - 1) / boxcox

    def back(x: float) -> float:
        if boxcox is None:
            return x
        return (float(np.exp(x)) if abs(boxcox) < 1e-9 else max(boxcox * x + 1, 0.0) ** (1 / boxcox)) - 0.001

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time).reset_index(drop=True)
        y, most = there(pdf[target].to_numpy(dtype=float)), max(lags)
        terms = [pdf[c].to_numpy(dtype=float) for c in inputs]
        if status:
            kinds = pdf[status].astype(str).to_numpy()
            terms = [t * (kinds == k) for k in np.unique(kinds) for t in [np.ones(len(pdf)), *terms]][1:]
        x = np.column_stack([np.ones(len(pdf)), *terms])
        lagged = np.column_stack([np.concatenate([np.full(k, np.nan), y[:-k]])[: len(y)] for k in lags])
        full = np.concatenate([x, lagged], axis=1)
        begin = max(len(pdf) - horizon, 0)
        ok = np.isfinite(full[:begin]).all(1) & np.isfinite(y[:begin])
        out = np.full(len(pdf) - begin, np.nan)
        if ok.sum() > full.shape[1] and begin >= most:
            beta = np.linalg.lstsq(full[:begin][ok], y[:begin][ok], rcond=None)[0]
            past = y[:begin].tolist()
            for i in range(begin, len(pdf)):
                p = float(np.concatenate([x[i], [past[i - k] for k in lags]]) @ beta)
                value = back(p) if low is None else max(back(p), low)
                out[i - begin] = value
                past.append(float(there(np.array([value]))[0]))
        return pdf.iloc[begin:][[*keys, time]].assign(predicted=out)

    return df.select(*keys, time, target, *inputs, *([status] if status else [])).groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, `{time}` {df.schema[time].dataType.simpleString()}, predicted double")


def recursive_coefficients(df: DataFrame, keys: list[str], inputs: list[str], target: str, forgetting: float = 0.99, warm_up: int = 0, time: str = "time") -> DataFrame:
    """(keys..., time, {input}...): least-squares coefficients after each row, older rows forgotten by ``forgetting``. The first ``warm_up`` rows take those after them. A series is one task."""
    require(df, time, target, *keys, *inputs)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        theta = recursive_least_squares(pdf[inputs].to_numpy(dtype=float), pdf[target].to_numpy(dtype=float), forgetting)
        if 0 < warm_up < len(theta):
            theta[:warm_up] = theta[warm_up]
        return pd.concat([pdf[[*keys, time]].reset_index(drop=True), pd.DataFrame(theta, columns=inputs)], axis=1)

    cols = ", ".join(f"`{c}` double" for c in inputs)
    return df.select(*keys, time, target, *inputs).groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, `{time}` {df.schema[time].dataType.simpleString()}, {cols}")


def recursive_predictions(df: DataFrame, coefficients: DataFrame, keys: list[str], inputs: list[str], horizon: str, time: str = "time", low: float | None = None) -> DataFrame:
    """(keys..., time, predicted) with the coefficients known ``horizon`` (an interval) before each row."""
    from gridlake.operators.joins import nearest_join

    shifted = coefficients.select(*keys, (F.col(time) + F.expr(f"INTERVAL {horizon}")).alias(time), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(inputs)])
    got = nearest_join(df.select(*keys, time, *inputs), shifted, keys, [f"_c{i}" for i in range(len(inputs))], time)
    p = sum((F.col(c) * F.col(f"_c{i}") for i, c in enumerate(inputs)), F.lit(0.0))
    return got.select(*keys, time, (p if low is None else F.greatest(p, F.lit(low))).alias("predicted"))


def regression_metrics(df: DataFrame, real: str, predicted: str, keys: list[str] | None = None) -> DataFrame:
    """RMSE and CVRMSE with a minus sign (greater is better), and R2 as squared correlation."""
    e = F.sqrt(F.avg(F.pow(F.col(real) - F.col(predicted), 2)))
    return df.dropna(subset=[real, predicted]).groupBy(*(keys or [])).agg((-F.try_divide(e, F.avg(real))).alias("CVRMSE"), (-e).alias("RMSE"), F.pow(F.corr(real, predicted), 2).alias("R2"))


def time_slices(df: DataFrame, keys: list[str], initial: int, horizon: int, skip: int, folds: int | None = None, time: str = "time", fixed: bool = False) -> DataFrame:
    """Rows with (fold, part): fold k trains on the first initial + k * (skip + 1) rows of a series (the last ``initial`` of them if ``fixed``) and tests on the ``horizon`` after.

    Without ``folds`` a series has as many as there are whole horizons for, to its end.
    """
    own, step = df.columns, F.lit(skip + 1)
    rows = numbered(df, keys, time).withColumnRenamed("_r", "_n")
    if folds is None:
        count = df.groupBy(*keys).agg(F.count("*").alias("_all")).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_all")
        rows = rows.join(count, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]).withColumn("_last", F.floor((F.col("_all") - initial - horizon) / step))
    else:
        rows = rows.withColumn("_last", F.lit(folds - 1).cast("bigint"))
    low = F.greatest(F.lit(0), F.floor((F.col("_n") - initial - horizon) / step) + 1)  # the first fold whose test has not ended before the row
    high = F.least("_last", F.floor(F.col("_n") / step)) if fixed else F.col("_last")
    rows = rows.withColumns({"_low": low, "_high": high}).where("_low <= _high").withColumn("fold", F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int"))))
    end = F.lit(initial) + F.col("fold") * (skip + 1)
    first = end - initial if fixed else F.lit(0)
    part = F.when((F.col("_n") >= first) & (F.col("_n") < end), "train").when((F.col("_n") >= end) & (F.col("_n") < end + horizon), "test")
    return rows.withColumn("part", part).where("part IS NOT NULL").select(*own, "fold", "part")


def prediction_intervals(df: DataFrame, keys: list[str], period: str, mean: str = "predicted", sigma: str = "sigma", how: str = "SUM", draws: int = 1000, floor: float | None = None, time: str = "time", tz: str = "UTC", seed: int = 1) -> DataFrame:
    """(keys..., time, mean, sd, q2_5...): quantiles of the aggregated predictions over normal draws.

    Draws of a row are independent, so without ``floor`` a bucket's sum is normal with the rows' summed
    means and variances: rows are added up first and each bucket is drawn, not each row. With
    ``floor`` every row is drawn and cut, and draws are added up per bucket before the shuffle. Draw k
    of a bucket or row depends on it and k alone.
    """
    b = bucket(F.col(time).cast("timestamp"), period, tz)
    u = lambda i: (F.pmod(F.xxhash64("_h", "_k", F.lit(i)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    x = F.col("_m") + F.col("_s") * F.sqrt(-2 * F.log(u(1))) * F.cos(2 * np.pi * u(2))
    drawn = F.explode(F.sequence(F.lit(1), F.lit(draws)))
    rows = df.select(*keys, b.alias("_b"), F.col(mean).alias("_m"), F.col(sigma).alias("_s"), F.xxhash64(*keys, time, F.lit(seed)).alias("_h"))
    if floor is None:
        n = F.lit(1.0) if how == "SUM" else F.count("_m")
        per = rows.groupBy(*keys, "_b").agg((F.sum("_m") / n).alias("_m"), (F.sqrt(F.sum(F.when(F.col("_m").isNotNull(), F.col("_s") * F.col("_s")))) / n).alias("_s"), F.xxhash64(*[F.col(k) for k in keys], F.col("_b"), F.lit(seed)).alias("_h"))
        per = per.withColumn("_k", drawn).select(*keys, "_b", x.alias("_x"))
    else:
        x = F.greatest(x, F.lit(floor))
        per = rows.withColumn("_k", drawn).groupBy(*keys, "_b", "_k").agg((F.sum(x) if how == "SUM" else F.avg(x)).alias("_x"))
    points = [2.5, 5, 10, 25, 50, 75, 90, 95, 97.5]
    got = per.groupBy(*keys, F.col("_b").alias("time")).agg(F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd"), F.percentile("_x", [p / 100 for p in points]).alias("_q"))
    return got.select(*keys, "time", "mean", "sd", *[F.col("_q")[i].alias("q" + f"{p:g}".replace(".", "_")) for i, p in enumerate(points)])


def disaggregate(df: DataFrame, predictor: Callable[[DataFrame], DataFrame], keys: list[str], heating: str, cooling: str, real: str, time: str = "time", least: float = 0.1) -> DataFrame:
    """Add baseload, heating_part and cooling_part by predicting without heating and without cooling, and the measured value split alike.

    ``predictor`` adds ``predicted``. Negative parts go to the baseload; parts are smoothed over
    three rows; where the prediction is under ``least`` the measured value is all baseload.
    """
    # One prediction over three versions of each row, told apart by _w: without both, without cooling, without heating.
    zero = F.lit(0.0)
    three = df.select(F.struct(*df.columns).alias("_row"), F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_w"))
    three = three.select(*[F.when(F.col("_w").isin(*gone), zero).otherwise(F.col("_row")[c]).alias(c) if gone else F.col("_row")[c].alias(c) for c in df.columns for gone in [{heating: (0, 2), cooling: (0, 1)}.get(c)]], "_row", "_w")
    part = lambda i: F.max(F.when(F.col("_w") == i, F.col("predicted")))
    got = predictor(three).groupBy("_row").agg(part(0).alias("_b"), part(1).alias("_h"), part(2).alias("_c")).select("_row.*", "_b", "_h", "_c")
    h, c = F.greatest(F.col("_h") - F.col("_b"), F.lit(0.0)), F.greatest(F.col("_c") - F.col("_b"), F.lit(0.0))
    w = Window.partitionBy(*keys).orderBy(time).rowsBetween(-1, 1)
    got = got.withColumns({"_h": F.avg(h).over(w), "_c": F.avg(c).over(w), "_b": F.avg("_b").over(w)})
    total = F.col("_h") + F.col("_c") + F.col("_b")
    share = lambda p: F.when(total > least, F.col(real) * F.col(p) / total)
    return got.select(*df.columns, F.col("_b").alias("baseload"), F.col("_h").alias("heating_part"), F.col("_c").alias("cooling_part"), F.coalesce(share("_b"), F.col(real)).alias("baseload_real"), F.coalesce(share("_h"), F.lit(0.0)).alias("heating_real"), F.coalesce(share("_c"), F.lit(0.0)).alias("cooling_real"))


def occupancy(df: DataFrame, keys: list[str], real: str, predicted: str, least: float = 0.2, window: int = 168, time: str = "time") -> DataFrame:
    """(keys..., time, occupancy) from the spread of the residuals; quiet stretches get ``least``, unknown ones the middle. A series is one task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(time)
        r = pdf[real].to_numpy(dtype=float) - pdf[predicted].to_numpy(dtype=float)
        n = np.arange(len(r), dtype=float)
        ok = np.isfinite(r)
        occ = np.full(len(r), (least + 1) / 2)
        if ok.sum() > 10:
            at = np.linspace(0, len(r) - 1, 40)
            r = r - np.interp(n, at, loess(n[ok], r[ok], at, 0.3))
            sd = pd.Series(r).rolling(window, min_periods=2).std().to_numpy()
            mean = pd.Series(pdf[real].to_numpy(dtype=float)).rolling(window, min_periods=1).mean().to_numpy()
            fine = sd[np.isfinite(sd)]
            x, d = density(fine) if len(fine) > 3 else (np.zeros(1), np.zeros(1))
            after = density_valleys(fine)[density_valleys(fine) > x[np.argmax(d)]] if len(fine) > 3 else np.zeros(0)
            busy = sd >= (after[0] if len(after) else -np.inf)
            top, low = np.nanmax(mean), np.nanmin(mean)
            level = (mean - low) / max(top - low, 1e-12) * (1 - least) + least
            occ = np.where(ok, np.where(busy, level, least), occ)
        return pdf[[*keys, time]].assign(occupancy=occ)

    return df.select(*keys, time, real, predicted).groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, `{time}` {df.schema[time].dataType.simpleString()}, occupancy double")


def white_noise_test(df: DataFrame, keys: list[str], residual: str, time: str = "time") -> DataFrame:
    """(keys..., outside): share of each series' cumulative periodogram outside the band of white noise."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(time)[residual].to_numpy(dtype=float)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "outside": [out_of_band_periodogram(x) if np.isfinite(x).sum() > 8 else np.nan]})

    return df.select(*keys, time, residual).groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, outside double")


def balance_temperature(df: DataFrame, predictor: Callable[[DataFrame], DataFrame], keys: list[str], temperature: str, cases: list[str]) -> DataFrame:
    """(keys..., tbal): the temperature at which the prediction, averaged over the observed cases, is lowest and flattest.

    The cases' distinct values (bin wide ones first) are predicted on a grid of whole degrees
    between the 5th and 95th percentile of each series.
    """
    ends = df.groupBy(*keys).agg(F.percentile(temperature, 0.05).cast("int").alias("_a"), F.percentile(temperature, 0.95).cast("int").alias("_z"))
    grid = df.select(*keys, *cases).distinct().join(ends, keys).withColumn("_t", F.explode(F.sequence("_a", "_z"))).withColumn(temperature, F.col("_t").cast("double"))
    mean = predictor(grid.drop("_a", "_z", "_t")).groupBy(*keys, temperature).agg(F.avg("predicted").alias("p"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(temperature)
        t, p = pdf[temperature].to_numpy(), pdf["p"].to_numpy()
        tbal = t[0]
        if len(t) > 3:
            s = loess(t, p, t, 0.5)
            slope = np.abs(np.gradient(s, t))
            flat = slope <= np.quantile(slope, 0.1)
            tbal = t[np.where(flat, s, np.inf).argmin()]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "tbal": [float(tbal)]})

    return mean.groupBy(*keys).applyInPandas(run, f"{_schema(df, keys)}, tbal double")


def disruptive_period(df: DataFrame, keys: list[str], first: tuple[str, str], last: tuple[str, str], tz: str, temperature: str = "temperature", value: str = "value", time: str = "time", check: str = "decrement", least: float | None = None, step_days: int = 7) -> DataFrame:
    """(keys..., start, end, change, rmse): the period that best explains a lasting change of daily consumption, NULLs if none.

    Candidates begin within ``first`` and end within ``last``, ``step_days`` apart; the best is then
    refined day by day around it. Daily consumption (mean times 24) is regressed on heating degrees
    below 14 to 20, cooling degrees above 20 to 26, weekends and the period. A period counts if it has
    more than 30 days with 70 or more outside it, and changes consumption by ``least`` percent or more
    (30 for ``check`` 'decrement', 60 for 'increment') in that direction; of those the smallest error
    plus a thousandth of its length wins. Series with fewer than 360 days give NULLs.

    A series comes as one row a day, so a task holds some hundreds of rows per series.
    """
    require(df, time, value, temperature, *keys)
    least = least if least is not None else 30.0 if check == "decrement" else 60.0
    day = F.to_date(F.from_utc_timestamp(F.col(time).cast("timestamp"), tz))
    days = df.groupBy(*keys, day.alias("date")).agg((F.avg(value) * 24).alias("v"), F.avg(temperature).alias("t"))
    spans = [pd.date_range(*w).to_numpy().astype("datetime64[D]").astype(int) for w in (first, last)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[np.isfinite(pdf["v"].to_numpy(dtype=float)) & np.isfinite(pdf["t"].to_numpy(dtype=float))]
        d = pd.to_datetime(pdf["date"]).to_numpy().astype("datetime64[D]").astype(int)
        y, t, off = pdf["v"].to_numpy(dtype=float), pdf["t"].to_numpy(dtype=float), (d + 3) % 7 >= 5
        best = (np.inf, None, None, np.nan)
        bases = [np.column_stack([np.ones(len(y)), np.maximum(h - t, 0), np.maximum(t - c, 0), off]) for h in range(14, 21, 2) for c in range(20, 27, 2)]
        # What the other terms explain is taken out once per pair of bases; a period is then one projection.
        rests = [(q := np.linalg.qr(x)[0], y - q @ (q.T @ y)) for x in bases] if len(y) >= 360 else []

        def tried(starts: np.ndarray, ends: np.ndarray) -> None:
            nonlocal best
            for a in starts:
                for z in ends:
                    inside = (d >= a) & (d <= z)
                    n = int(inside.sum())
                    if z <= a or n <= 30 or len(y) - n < 70:
                        continue
                    for q, rest in rests:
                        f = inside - q @ (q.T @ inside)
                        size = f @ f
                        if size < 1e-9:
                            continue
                        effect = (f @ rest) / size
                        change = 100 * effect / max(np.mean(y[~inside]), 1e-9)
                        if (change if check == "increment" else -change) < least:
                            continue
                        score = np.sqrt(max(rest @ rest - effect**2 * size, 0.0) / len(y)) + n / 1000
                        if score < best[0]:
                            best = (score, a, z, change)

        if rests:
            tried(spans[0][::step_days], spans[1][::step_days])
            if best[1] is not None:
                near = lambda w, c: w[np.abs(w - c) < step_days]
                tried(near(spans[0], best[1]), near(spans[1], best[2]))
        as_time = lambda k: pd.NaT if k is None else pd.Timestamp(int(k), unit="D")
        return pd.DataFrame({"start": [as_time(best[1])], "end": [as_time(best[2])], "change": [best[3]], "rmse": [best[0] if np.isfinite(best[0]) else np.nan]})

    def of_key(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([pd.DataFrame([key], columns=keys), run(pdf)], axis=1)

    return days.groupBy(*keys).applyInPandas(of_key, f"{_schema(df, keys)}, start timestamp, end timestamp, change double, rmse double")


def input_grid(values: dict[str, list], sample: int | None = None, seed: int = 1) -> list[dict]:
    """All combinations of the parameters' values in order, or ``sample`` of them chosen at random."""
    grid = [dict(zip(values, v, strict=True)) for v in product(*values.values())]
    return grid if sample is None or sample >= len(grid) else [grid[i] for i in sorted(random.Random(seed).sample(range(len(grid)), sample))]


def tune_linear(df: DataFrame, keys: list[str], grid: list[dict], terms: Callable[[dict], dict[str, Column]], target: str, initial: int, horizon: int, skip: int, fixed: bool = False, time: str = "time") -> tuple[DataFrame, DataFrame]:
    """(scores, best) of linear models over time slices: (keys..., params, folds, RMSE) and each series' params of the smallest RMSE.

    ``terms`` gives the model's terms for a set of parameters, the same names for all. All sets and
    folds are fitted together: the rows are reduced to cross-products per series, fold and set by one
    aggregation, and tested by one join. ``params`` is the set as JSON; ties go to the alphabetically
    first. Rows with NULLs count in the slices but neither train nor test.
    """
    require(df, time, target, *keys)
    names = list(terms(grid[0]))
    sliced = time_slices(df.select(*df.columns), keys, initial, horizon, skip, time=time, fixed=fixed)
    sets = [F.struct(F.lit(json.dumps(g, sort_keys=True)).alias("params"), *[c.cast("double").alias(n) for n, c in terms(g).items()]) for g in grid]
    rows = sliced.select(*keys, "fold", "part", F.col(target).cast("double").alias("_y"), F.inline(F.array(*sets))).dropna(subset=["_y", *names])
    group = [*keys, "fold", "params"]
    fits = penalised_linear(rows.where("part = 'train'"), group, names, "_y").groupBy(*group).agg(*[F.max(F.when(F.col("term") == n, F.col("coefficient"))).alias("_b" + n) for n in names])
    error = F.col("_y") - sum((F.col(n) * F.col("_b" + n) for n in names), F.lit(0.0))
    tested = rows.where("part = 'test'").join(fits, group).groupBy(*keys, "params").agg(F.count_distinct("fold").alias("folds"), F.sqrt(F.avg(error * error)).alias("RMSE"))
    return tested, tested.groupBy(*keys).agg(F.min_by("params", F.struct("RMSE", "params")).alias("params"), F.min("RMSE").alias("RMSE"))


def recursive_forecast(df: DataFrame, predictor: Callable[[DataFrame], DataFrame], keys: list[str], target: str, lags: list[int], horizon: int, time: str = "time", low: float | None = None) -> DataFrame:
    """(keys..., time, predicted): each series' last ``horizon`` rows by any fitted model, each from the predictions before it.

    ``predictor`` adds ``predicted`` to rows with {target}_l{k} for each lag, so forests and generalised
    models recur as linear ones do. All series take a step together, ``horizon`` steps in all; a
    step's rows are one per series. The rows that steps need are the last horizon + max(lags) only.
    """
    require(df, time, target, *keys)
    back = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(time)))
    rows = cut(df.withColumn("_n", back).where(F.col("_n") <= horizon + max(lags)).withColumn("_n", horizon - F.col("_n")))  # 0 is the first to predict
    known = rows.where("_n < 0").select(*keys, "_n", F.col(target).cast("double").alias("_y"))
    out: DataFrame | None = None
    for h in range(horizon):
        past = known.where(F.col("_n").isin([h - k for k in lags])).groupBy(*keys).agg(*[F.max(F.when(F.col("_n") == h - k, F.col("_y"))).alias(f"{target}_l{k}") for k in lags])
        now = predictor(rows.where(F.col("_n") == h).join(past, keys, "left"))
        p = F.col("predicted") if low is None else F.greatest("predicted", F.lit(low))
        now = cut(now.select(*keys, time, p.alias("predicted")))
        out = now if out is None else out.unionByName(now)
        known = known.unionByName(now.select(*keys, F.lit(h).alias("_n"), F.col("predicted").alias("_y")))
    return out


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def serialise(state: dict) -> str:
    """Fitted limits, scalings, coefficients and the like as compressed text."""
    return lzma.compress(json.dumps(state, sort_keys=True).encode()).hex()


def unserialise(text: str | None) -> dict | None:
    """The state, or None for what isn't one."""
    try:
        return json.loads(lzma.decompress(bytes.fromhex(text or "")))
    except (ValueError, lzma.LZMAError, EOFError):
        return None


def status_terms(status: str, terms: list[Feature]) -> list[Feature]:
    """The terms, each in its own version per category of ``status``."""
    by = Feature(f"s_{status}", categories=status)
    return [Feature(f"{t.name}_by_{status}", factors=(by, t)) for t in terms]


def lag_terms(name: str, lags: list[int]) -> list[Feature]:
    """Terms of lag columns made by lag_components()."""
    return [Feature(f"{name}_l{k}", expr=f"`{name}_l{k}`") for k in lags]

