"""Where the mixtures start, which columns are used, and packed points."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture
from pyspark.sql import functions as F

from tabvet.operators import fidelity as FI
from tabvet.operators import mixtures as M


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(4000, numPartitions=3).select((F.col("id") * 7919 % 1009).cast("double").alias("x"),
                                                     F.sqrt(F.col("id") % 531).alias("y"))


def test_starts_are_spark_s_own(spark, rows):
    f = FI._features(rows, ["x", "y"])
    for k, m in zip((2, 3, 7), M.starts(rows, [2, 3, 7], 42)):
        want = GaussianMixture(k=k, seed=42, featuresCol="features", maxIter=0).fit(f)
        parts = want.gaussiansDF.collect()
        assert np.allclose(m.weights, want.weights)
        assert np.allclose(m.means, [g["mean"].toArray() for g in parts])
        assert np.allclose(m.covs, [g["cov"].toArray() for g in parts])


def test_a_start_is_one_job_that_only_draws_rows(spark, rows):
    sc = spark.sparkContext
    f = FI._features(rows, ["x", "y"])
    sc.setJobGroup("starts", "starts")
    M.starts(f, [2, 3, 4, 5], 42)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert len(sc.statusTracker().getJobIdsForGroup("starts")) <= 4 + 2  # a count besides


def test_packed_points_are_the_points(spark, rows):
    cols = ["x", "y"]
    pts = M.points(rows, cols, 4000)
    packed = M.packed(pts, cols, 4000).cache()
    assert packed.count() < 100
    blocks = [np.frombuffer(r["points"]).reshape(3, -1) for r in packed.collect()]
    assert {tuple(p) for b in blocks for p in b.T} == {tuple(r) for r in pts.collect()}
    begun = M.starts(rows, [2, 3], 42)
    for a, b in zip(M.fit(packed, cols, begun, rounds=5), M.fit(pts, cols, begun, rounds=5)):
        assert np.allclose(a.covs, b.covs, rtol=1e-9) and a.log_likelihood == pytest.approx(b.log_likelihood, rel=1e-12)
    packed.unpersist()


def test_columns_with_more_values_than_asked(spark):
    nan = float("nan")
    df = spark.createDataFrame([(0.0, 1.0, None), (-0.0, 2.0, 1.0), (nan, 3.0, None), (-nan, 4.0, 1.0), (None, 5.0, 1.0)] * 50,
                               "a double, b double, c double").repartition(7)
    assert M.varied(df, ["a", "b", "c"], 1) == ["a", "b"]
    assert M.varied(df, ["a", "b", "c"], 2) == ["b"]
    assert M.varied(df, ["a", "b", "c"], 4) == ["b"] and M.varied(df, ["a", "b", "c"], 5) == []


def test_densities_near_and_far_of_wide_and_narrow_components(monkeypatch):
    covs = np.array([[[4.0, 1.0], [1.0, 9e6]], [[1e-12, 0.0], [0.0, 25.0]], [[2.0, 0.0], [0.0, 0.0]]])
    m = M.Mixture(np.array([0.5, 0.3, 0.2]), np.array([[10.0, 5e4], [3.0, 7e4], [20.0, 6e4]]), covs)
    x = np.random.default_rng(1).normal([[10.0], [5e4]], [[3.0], [9e3]], (2, 300))
    x[:, :20] = m.means[1][:, None] + np.linspace(-2, 2, 20) * [[1e-6], [5.0]]
    want = np.empty((3, 300))
    for i, c in enumerate(covs):
        values, vectors = np.linalg.eigh(c)
        used = values > 0
        q = (((x - m.means[i][:, None]).T @ vectors[:, used]) ** 2 / values[used]).sum(1)
        want[i] = m.weights[i] * np.exp(-0.5 * q) / (2 * np.pi * np.sqrt(values[used].prod())) + M.EPSILON
    assert np.allclose(M._densities([m])(x), want, rtol=1e-6)
    wide = M.Mixture(m.weights[:1], m.means[:1], covs[:1])
    quick = M._densities([wide])(x).copy()
    monkeypatch.setattr(M, "ROUNDED", 0.0)
    assert np.allclose(quick, M._densities([wide])(x), rtol=1e-10)
