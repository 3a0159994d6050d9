"""Mixtures fitted side by side against Spark's own, one at a time."""

import numpy as np
import pytest
from pyspark.ml.clustering import GaussianMixture

from tabvet.operators import fidelity as FI
from tabvet.operators import mixtures as M


@pytest.fixture(scope="module")
def blobs(spark):
    r = np.random.default_rng(4)
    xy = np.concatenate([r.normal(c, 1.0, (120, 2)) for c in ((0, 0), (9, 1), (4, 8))])
    rows = [(float(a), float(b)) for a, b in xy] + [(1.0, 2.0)] * 30
    return spark.createDataFrame(rows, "x double, y double").coalesce(1)


def test_same_mixtures_as_one_at_a_time(spark, blobs):
    cols, sizes = ["x", "y"], [2, 3, 4]
    f = FI._features(blobs, cols)
    pts = M.points(f, cols, 390)
    assert pts.agg({"n": "sum"}).first()[0] == 390 and pts.count() == 361
    got = M.fit(pts, cols, M.starts(f, sizes, 42), rounds=25)
    for k, m in zip(sizes, got):
        want = GaussianMixture(k=k, seed=42, featuresCol="features", maxIter=25).fit(f)
        assert np.allclose(m.weights, want.weights, atol=1e-8)
        assert np.allclose(m.means, [g["mean"].toArray() for g in want.gaussiansDF.collect()], atol=1e-6)
        assert np.allclose(m.covs, [g["cov"].toArray() for g in want.gaussiansDF.collect()], atol=1e-6)
        assert m.log_likelihood == pytest.approx(want.summary.logLikelihood, rel=1e-9)
        modes = {r["prediction"]: r["count"] for r in want.transform(f).groupBy("prediction").count().collect()}
        assert {r["m"]: r["n"] for r in M.mode_counts(pts, cols, m, "n").collect()} == modes


def test_a_round_is_one_job_for_all_sizes(spark, blobs):
    sc = spark.sparkContext
    cols = ["x", "y"]
    f = FI._features(blobs, cols)
    begun = M.starts(f, [2, 3, 4, 5], 42)
    pts = M.points(f, cols, 390).cache()
    pts.count()
    sc.setJobGroup("rounds", "rounds")
    M.fit(pts, cols, begun, rounds=6, tol=0.0)
    assert len(sc.statusTracker().getJobIdsForGroup("rounds")) <= 2 * 6
    sc.setLocalProperty("spark.jobGroup.id", None)
    pts.unpersist()


def test_coverage_with_nulls_and_without_synthetic_rows_of_a_mode(spark, blobs):
    real = blobs.union(spark.createDataFrame([(None, 1.0), (float("nan"), 2.0)], "x double, y double"))
    rows = FI.gmm_coverage(real, blobs.filter("y < 5"), ["x", "y"], k_range=(3, 3)).collect()
    assert sum(r["real_share"] for r in rows) == pytest.approx(1) and len(rows) == 3
    assert min(r["synth_share"] for r in rows) < 0.02
