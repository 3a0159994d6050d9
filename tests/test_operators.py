"""Operators against brute force on small fixtures."""

import hashlib
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabvet.operators import encode as E
from tabvet.operators import generate as G
from tabvet.operators import privacy as PV
from tabvet.operators import powerlaw as PL
from tabvet.operators import profile as P


def test_grid_knn_matches_brute_force(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(0, 1, (300, 2)) * [100.0, 1.0]
    query = rng.normal(0, 1, (40, 2)) * [100.0, 1.0]
    bdf = spark.createDataFrame(pd.DataFrame({"a": base[:, 0], "b": base[:, 1]}))
    qdf = spark.createDataFrame(pd.DataFrame({"id": range(40), "a": query[:, 0], "b": query[:, 1]}))
    got = PV.knn(qdf, bdf, ["a", "b"], "id", 5).toPandas().set_index("id").sort_index()
    d = np.sqrt(((query[:, None, :] - base[None, :, :]) ** 2).sum(-1))
    d.sort(axis=1)
    assert np.allclose(got["kth_distance"].values, d[:, 4])
    assert np.allclose(got["mean_distance"].values, d[:, :5].mean(1))


def test_knn_pairs_neighbours(spark):
    rng = np.random.default_rng(4)
    pts = rng.uniform(0, 50, (60, 2))
    df = spark.createDataFrame(pd.DataFrame({"k": range(60), "x": pts[:, 0], "y": pts[:, 1]}))
    got = PV.knn_pairs(df, ["x", "y"], "k", 3).toPandas()
    d = np.sqrt(((pts[:, None, :] - pts[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(d, np.inf)
    for k in range(60):
        exp = set(np.argsort(d[k], kind="stable")[:3])
        assert set(got[got["k"] == k]["neighbor"]) == exp


def _numpy_power_law(freqs, min_n_tail=100, min_frac=0.05):
    freqs = np.asarray(freqs)
    best = None
    for x_min in np.unique(freqs)[-1000:]:
        tail = freqs[freqs >= x_min]
        if len(tail) < min_n_tail or len(tail) / len(freqs) < min_frac:
            continue
        s = np.log(tail / x_min).sum()
        if s <= 0:
            continue
        a = 1 + len(tail) / s
        u = np.unique(tail)
        ecdf = np.array([np.mean(tail <= v) for v in u])
        ks = np.max(np.abs(ecdf - (1 - (u / x_min) ** (1 - a))))
        if best is None or ks < best[2]:
            best = (x_min, a, ks, len(tail))
    return best


def test_power_law_fit_matches_numpy(spark):
    rng = np.random.default_rng(5)
    freqs = np.minimum(rng.zipf(2.0, 300), 1000)
    cats = np.repeat(np.arange(300), freqs)
    df = spark.createDataFrame(pd.DataFrame({"c": cats}))
    got = PL.power_law_fit(df, "c").first()
    freqs = pd.Series(cats).value_counts().values
    x_min, a, ks, n_tail = _numpy_power_law(freqs)
    assert got["x_min"] == x_min and got["n_tail"] == n_tail
    assert got["alpha"] == pytest.approx(a) and got["ks"] == pytest.approx(ks)


@pytest.mark.parametrize("n", [32, 10])
def test_hash_bucket_matches_md5_integer(spark, n):
    vals = ["Customer#000000001", "x", "42", "héllo"]
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    idx, sign = E.hash_bucket(F.col("v"), n)
    got = df.select("v", idx.alias("i"), sign.alias("s")).collect()
    for r in got:
        h = int(hashlib.md5(r["v"].encode()).hexdigest(), 16)
        assert r["i"] == h % n
        assert r["s"] == (1.0 if (h // n) % 2 == 0 else -1.0)


def test_quantile_transform_roundtrip(spark):
    rng = np.random.default_rng(6)
    x = rng.lognormal(3, 1, 3000)
    df = spark.createDataFrame(pd.DataFrame({"k": range(3000), "x": x}))
    qg = E.QuantileGaussian("x", 1000).fit(df)
    z = qg.transform(df, "z")
    back = qg.inverse(z, "z", "xb").toPandas()
    assert back["z"].abs().max() <= 5.2
    assert np.allclose(back["xb"], back["x"], rtol=1e-3, atol=1e-3)
    # the median maps to ~0
    assert abs(np.median(back["z"])) < 0.01


def test_smote_counts(spark):
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"k": range(200), "a": rng.normal(0, 1, 200), "b": rng.normal(5, 2, 200),
                        "y": [1] * 20 + [0] * 180, "tag": ["m"] * 20 + ["M"] * 180})
    df = spark.createDataFrame(pdf)
    out = G.smote(spark, df, "y", 1, "k", ["a", "b"], k=5).toPandas()
    syn = out[out["synthetic"]]
    assert len(syn) == 200 - 2 * 20
    assert (syn["y"] == 1).all() and (syn["tag"] == "m").all()
    mino = pdf[pdf["y"] == 1]
    assert syn["a"].between(mino["a"].min(), mino["a"].max()).all()


def test_boxcox_lambda_close_to_grid_optimum(spark):
    rng = np.random.default_rng(8)
    x = rng.lognormal(2, 0.5, 2000)
    df = spark.createDataFrame(pd.DataFrame({"x": x}))
    lam = E.boxcox_lambda(df, "x")
    y = x + 1.0

    def llf(l):
        t = np.log(y) if abs(l) < 1e-12 else (y ** l - 1) / l
        return (l - 1) * np.log(y).sum() - len(y) / 2 * np.log(t.var())
    grid = np.linspace(-2, 2, 4001)
    best = grid[np.argmax([llf(g) for g in grid])]
    assert lam == pytest.approx(best, abs=2e-3)
