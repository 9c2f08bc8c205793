"""Forests grown from sums per cell, against Spark's own forest, planted steps and other spreads of the rows."""

import time

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import functions as F

from gridlake.operators import forest
from gridlake.operators import models as m

TERMS = [m.Feature("t", expr="t"), m.Feature("h", expr="h"), m.Feature("w", expr="w")]


def rows(spark, n):
    noise = (F.pmod(F.xxhash64("id"), F.lit(1000)) - 500) / 100.0
    df = spark.range(n, numPartitions=5).withColumns({"t": F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5000)) / 100.0, "h": F.pmod(F.xxhash64("id", F.lit(2)), F.lit(24)).cast("int"), "w": F.pmod(F.xxhash64("id", F.lit(3)), F.lit(7)).cast("int")})
    return df.withColumn("y", 20 + 2 * F.greatest(16 - F.col("t"), F.lit(0.0)) + F.when((F.col("h") >= 8) & (F.col("w") < 5), 30.0).otherwise(0.0) + noise)


def test_forest_does_not_depend_on_how_rows_are_spread(spark):
    df = rows(spark, 6000).localCheckpoint()
    seen = []
    for spread in (df.repartition(3, "h"), df.repartition(7)):
        p = m.predict(m.fit_forest(spread, TERMS, "y", trees=25), df)
        seen.append(np.array([r["predicted"] for r in p.orderBy("id").collect()]))
    assert np.abs(seen[0] - seen[1]).max() < 1e-9
    other = np.array([r["predicted"] for r in m.predict(m.fit_forest(df, TERMS, "y", trees=25, seed=2), df).orderBy("id").collect()])
    assert 0.01 < np.abs(seen[0] - other).max()


def test_forest_agrees_with_sparks_own(spark, monkeypatch):
    df = rows(spark, 6000).localCheckpoint()
    model = m.fit_forest(df, TERMS, "y", trees=200)
    assert isinstance(model.stages[-1], forest.ForestModel)
    monkeypatch.setattr(forest, "CELLS", 10)  # more cells than that: Spark's own
    own = m.fit_forest(df, TERMS, "y", trees=200)
    assert isinstance(own.stages[-1], RandomForestRegressionModel)
    both = m.predict(own, m.predict(model, df).withColumnRenamed("predicted", "p")).agg(F.corr("p", "predicted").alias("r"), F.avg(F.abs(F.col("p") - F.col("predicted"))).alias("d"), F.stddev("predicted").alias("s")).first()
    assert both["r"] > 0.99
    assert both["d"] < 0.1 * both["s"]


def test_heavy_cells_are_drawn_in_parts_and_few_rows_give_their_mean(spark, monkeypatch):
    df = spark.range(4000, numPartitions=4).selectExpr("id", "CAST(id % 2 AS double) AS t", "1 AS h", "1 AS w", "CAST(10 * (id % 2) + id % 3 AS double) AS y").localCheckpoint()
    monkeypatch.setattr(forest, "CELL_ROWS", 500)
    got = {r["t"]: r["predicted"] for r in m.predict(m.fit_forest(df, TERMS[:1], "y", trees=50), df).groupBy("t").agg(F.avg("predicted").alias("predicted")).collect()}
    assert got[0.0] == pytest.approx(1.0, abs=0.05)
    assert got[1.0] == pytest.approx(11.0, abs=0.05)
    few = df.where("id < 8")  # four rows a side: no split leaves six in each leaf
    flat = m.predict(m.fit_forest(few, TERMS[:1], "y", trees=200), few)
    assert flat.agg(F.count_distinct("predicted")).first()[0] <= 2
    assert flat.agg(F.avg("predicted")).first()[0] == pytest.approx(few.agg(F.avg("y")).first()[0], abs=1.0)


def test_edges_hold_every_value_of_few_and_quantiles_of_many(spark, monkeypatch):
    x = spark.range(10_000).selectExpr("array(CAST(id AS double), CAST(if(id = 7, 1, 0) AS double), 3.0D) AS x")
    many, rare, one = forest.thresholds(x, "x")
    assert len(many) == 31
    assert np.abs(many - 10_000 * np.arange(1, 32) / 32).max() < 20
    assert rare.tolist() == [0.5]
    assert one.tolist() == []
    monkeypatch.setattr(forest, "VALUES", 100)
    assert np.abs(forest.thresholds(x, "x")[0] - many).max() < 20


def test_bootstrap_sums(spark):
    y = np.arange(50.0)
    n, s = forest.drawn(y, 4000, np.random.default_rng(1))
    assert n.mean() == pytest.approx(50, abs=0.5)
    assert n.var() == pytest.approx(50, rel=0.1)
    assert s.mean() == pytest.approx(y.sum(), rel=0.01)
    assert s.var() == pytest.approx((y**2).sum(), rel=0.1)
    assert forest.drawn(y[:1], 4000, np.random.default_rng(1))[0].min() == 0


def test_forest_is_saved_and_read(spark, tmp_path):
    df = rows(spark, 1000).localCheckpoint()
    model = m.fit_forest(df, TERMS, "y", trees=12)
    m.save_model(model, str(tmp_path / "forest"))
    p, q = (m.predict(x, df).orderBy("id").collect() for x in (model, m.load_model(str(tmp_path / "forest"))))
    assert p == q


def test_500_trees_over_many_rows_in_time(spark):
    """500 passes over all rows took longer by far."""
    df = rows(spark, 300_000).localCheckpoint()
    began = time.time()
    got = m.regression_metrics(m.predict(m.fit_forest(df, TERMS, "y"), df), "y", "predicted").first()
    assert time.time() - began < 60
    assert got["R2"] > 0.93
