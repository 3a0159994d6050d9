"""Shapiro-Wilk against published figures and a NumPy version."""

import math
from statistics import NormalDist

import numpy as np
import pytest

from tabvet.operators import profile as P

# Weights of eleven men, a published example with W = 0.79, p = 0.0067.
MEN = [148.0, 154.0, 158.0, 160.0, 161.0, 162.0, 166.0, 170.0, 182.0, 195.0, 236.0]
R = np.random.default_rng(4)
DATA = {
    "men": MEN, "three": [1.0, 2.0, 4.0], "five": [1.0, 2.0, 2.5, 3.0, 9.0], "six": [1.0, 2.0, 2.5, 3.0, 9.0, 9.5],
    "normal": R.normal(size=800).tolist(), "rounded": np.round(R.normal(size=800), 1).tolist(),
    "exponential": R.exponential(size=500).tolist(), "limit": R.normal(size=5000).tolist(),
    "over": R.normal(size=5001).tolist(), "flat": [3.0] * 50, "pair": [1.0, 2.0], "none": [],
}


def brute(x):
    inv, n = NormalDist().inv_cdf, len(x)
    x = np.sort(x)
    m = np.array([inv((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    mm, u = (m ** 2).sum(), 1 / math.sqrt(n)
    a = m.copy()
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0, math.sqrt(0.5)])
    else:
        last = np.polyval(P.SW_LARGEST[::-1], u) + m[-1] / math.sqrt(mm)
        ends, tops = 1, [last]
        if n > 5:
            ends, tops = 2, [np.polyval(P.SW_SECOND[::-1], u) + m[-2] / math.sqrt(mm), last]
        rest = (mm - 2 * (m[n - ends:] ** 2).sum()) / (1 - 2 * (np.array(tops) ** 2).sum())
        a = m / math.sqrt(rest)
        a[n - ends:] = tops
        a[:ends] = -np.array(tops[::-1])
    return (a @ x) ** 2 / ((x - x.mean()) ** 2).sum()


@pytest.fixture(scope="module")
def got(spark):
    longest = max(map(len, DATA.values()))
    rows = [tuple(x[i] if i < len(x) else None for x in DATA.values()) for i in range(longest)]
    df = spark.createDataFrame(rows, ", ".join(f"`{k}` double" for k in DATA))
    return {r["feature"]: r for r in P.shapiro_wilk(df, list(DATA)).collect()}


def test_published_example(got):
    assert got["men"]["shapiro_w"] == pytest.approx(0.78881, abs=1e-4)
    assert got["men"]["shapiro_p"] == pytest.approx(0.0067, abs=1e-4)
    assert got["men"]["is_gaussian"] is False


@pytest.mark.parametrize("name", ["men", "three", "five", "six", "normal", "rounded", "exponential", "limit"])
def test_w_equals_numpy(got, name):
    assert got[name]["shapiro_w"] == pytest.approx(brute(np.array(DATA[name])), abs=1e-6)
    assert 0 <= got[name]["shapiro_p"] <= 1


def test_verdicts(got):
    assert got["normal"]["is_gaussian"] and got["limit"]["is_gaussian"]
    assert not got["exponential"]["is_gaussian"] and got["exponential"]["shapiro_p"] < 1e-10
    for name in ("over", "flat", "pair"):
        assert got[name]["shapiro_w"] is None and got[name]["is_gaussian"] is None, name


def test_p_is_uniform_under_normality(spark):
    cols = [f"c{k}" for k in range(60)]
    df = spark.createDataFrame([tuple(map(float, r)) for r in R.normal(size=(40, 60))], cols)
    p = np.array([r["shapiro_p"] for r in P.shapiro_wilk(df, cols).collect()])
    assert len(p) == 60 and 0.35 < p.mean() < 0.65 and (p < 0.05).mean() < 0.2
