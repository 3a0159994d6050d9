"""Forests grown from counts of cells against Spark's own."""

import numpy as np
import pytest
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabvet.operators import forest
from tabvet.operators import privacy as PV


@pytest.fixture(scope="module")
def cells():
    r = np.random.default_rng(3)
    rows = r.integers(0, 6, (2, 12 * 9))
    rows[1] += (np.add.outer(np.arange(12), np.arange(9)).ravel() % 7 > 3) * r.integers(0, 9, 12 * 9)
    return rows


@pytest.mark.parametrize("depth", [2, 5, 10])
def test_a_tree_is_spark_s_own(spark, cells, depth):
    weights = [1.7, 0.6]
    bins = np.array(np.unravel_index(np.arange(cells.shape[1]), (12, 9)))
    rows = [(float(c), weights[c], float(x), float(y)) for c in (0, 1) for n, x, y in zip(cells[c], *bins) for _ in range(n)]
    data = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame(rows, "label double, w double, x double, y double"))
    model = RandomForestClassifier(numTrees=1, maxDepth=depth, weightCol="w", bootstrap=False, seed=1).fit(data)
    every = VectorAssembler(inputCols=["x", "y"], outputCol="features").transform(
        spark.createDataFrame([(float(x), float(y)) for x, y in bins.T], "x double, y double").coalesce(1))
    want = {(r["x"], r["y"]): r["rawPrediction"][1] for r in model.transform(every).collect()}
    got = forest.grown(cells[None], bins, [12, 9], weights, depth, 2, np.random.default_rng(0))[0]
    assert np.allclose(got, [want[float(x), float(y)] for x, y in bins.T])
    held = cells[:, ::-1]
    scored = spark.createDataFrame([(float(c), float(s)) for c in (0, 1) for n, s in zip(held[c], got) for _ in range(n)],
                                   "label double, rawPrediction double")
    assert forest.auc(got, held) == pytest.approx(BinaryClassificationEvaluator().evaluate(scored), abs=1e-9)


def test_counts_and_bounds_are_of_all_rows(spark):
    data = spark.range(60_000).select((F.col("id") % 3 == 0).cast("double").alias("label"), (F.col("id") % 4).alias("parts"),
                                      (F.col("id") * 7919 % 59_999).cast("double").alias("x"), (F.col("id") % 5).cast("double").alias("y"))
    splits = forest.bounds(data.repartition(3), ["x", "y"], [1.0, 1.0], 2)
    for x, y in splits:
        assert y.tolist() == [0.5, 1.5, 2.5, 3.5] and len(x) == 31
        assert np.abs(x - 59_999 / 32 * np.arange(1, 32)).max() < 59_999 / 500
    for i, n in enumerate(forest.counts(data, ["x", "y"], splits)):
        rows = data.select("label", F.expr(f"parts >> {i} & 1").alias("p"), "x", "y").collect()
        want = np.zeros((2, 2, 32 * 5), int)
        for r in rows:
            want[r["p"], int(r["label"]), int((splits[i][0] < r["x"]).sum()) * 5 + int(r["y"])] += 1
        assert (n == want).all()


def test_many_rows_need_no_pass_per_level(spark, monkeypatch):
    monkeypatch.setattr(PV, "TASK_ROWS", 2000)
    u = F.rand(5)
    rows = spark.range(9000, numPartitions=2).select("id", (F.col("id") * 7919 % 997).cast("double").alias("x"), u.alias("u"))
    rows = rows.select("id", "x", F.when((F.col("id") % 3 == 0) & (F.col("u") < 0.8), F.col("u")).otherwise(F.col("u") * 2).alias("y"))
    parts = [rows.filter(f"id % 3 = {i}").select("x", "y") for i in (1, 0, 2)]
    sc = spark.sparkContext
    sc.setJobGroup("forests", "forests")
    got = PV.membership_risk(*parts, ["x", "y"], trees=30, depth=6).first()
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("forests")) <= 12
    monkeypatch.setattr(PV, "TASK_ROWS", 50_000)
    want = PV.membership_risk(*parts, ["x", "y"], trees=30, depth=6).first()
    assert got["n_shadow"] == want["n_shadow"] == 3 and want["auc_mean"] > 0.6
    assert got["auc_mean"] == pytest.approx(want["auc_mean"], abs=0.02)
