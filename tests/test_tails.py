"""Generalised-Pareto shapes against a dense search in NumPy."""

import numpy as np
import pytest

from tabvet.operators import tails as T


def optimum(e):
    """Best shape (from -1 on) over a dense sweep of tau, refined twice."""
    def curve(tau):
        shape = np.array([np.log1p(t * e).mean() for t in tau])
        with np.errstate(all="ignore"):
            fit = -(np.log(shape / tau) + shape + 1)
        fit[~np.isfinite(fit) | (shape < -1)] = -np.inf
        return shape, fit

    tau = np.concatenate([-(1 - np.logspace(-7, -0.001, 2000)) / e.max(), np.logspace(-5, 8, 4000) / np.exp(np.log(e).mean())])
    tau.sort()
    for _ in range(3):
        shape, fit = curve(tau)
        k = int(fit.argmax())
        best = shape[k]
        tau = np.linspace(tau[max(k - 1, 0)], tau[min(k + 1, len(tau) - 1)], 801)
    return best


R = np.random.default_rng(5)
U = R.random(4000)
TAILS = {
    "heavy": U ** -1.5 - 1, "moderate": (U ** -0.6 - 1) / 0.6, "exponential": -np.log(U), "bounded": (1 - U ** 0.5) / 0.5,
    "uniform": U, "wide": 1e6 * (U ** -3.0 - 1), "small": R.random(11), "ties": np.ceil(-np.log(U) * 3),
}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(k, float(x)) for k, e in TAILS.items() for x in e]
    df = spark.createDataFrame(rows, "feature string, e double")
    counts = df.groupBy("feature", "e").count().withColumnRenamed("count", "cnt")
    return {r.feature: r for r in T.fit(counts).collect()}


@pytest.mark.parametrize("name", TAILS)
def test_shapes(fitted, name):
    assert fitted[name].n_excess == len(TAILS[name])
    assert fitted[name].shape == pytest.approx(optimum(TAILS[name]), abs=1e-3)


def test_known_shapes(fitted):
    for name, shape in (("heavy", 1.5), ("moderate", 0.6), ("exponential", 0.0), ("bounded", -0.5), ("wide", 3.0)):
        assert fitted[name].shape == pytest.approx(shape, abs=0.12)


def test_bands(spark):
    got = [r[0] for r in spark.createDataFrame([(x,) for x in (-1.0, 0.2999, 0.3, 0.9999, 1.0, None)], "s double")
           .select(T.label_of(T.F.col("s"))).collect()]
    assert got == ["LIGHT_TAILED", "LIGHT_TAILED", "MODERATE_TAILED", "MODERATE_TAILED", "HEAVY_TAILED", "UNKNOWN"]


def test_whole_columns(spark):
    wide = [(float(v), float(k % 50), None if k % 3 else 1.0) for k, v in enumerate(10 + TAILS["heavy"])]
    got = {r.feature: r for r in T.tail_behavior(spark.createDataFrame(wide, "a double, b double, c double"), ["a", "b", "c"]).collect()}
    assert got["a"].tail_behavior == "HEAVY_TAILED" and got["a"].n_excess == 400
    assert got["b"].tail_behavior == "LIGHT_TAILED"
    assert got["c"].tail_behavior == "INSUFFICIENT_DATA" and got["c"].tail_index is None and got["c"].n_excess == 0
