"""Largest and mean pairwise distance against all pairs in NumPy."""

import numpy as np
import pytest

from tabvet.operators import spread as S

R = np.random.default_rng(8)
T = R.random(300) * 2 * np.pi
SHAPES = {
    "cloud": R.normal(size=(3000, 2)) * [1, 50],
    "line": R.random((500, 1)),
    "circle": np.c_[np.cos(T), np.sin(T)],
    "six columns": R.normal(size=(400, 6)),
    "far point": np.r_[R.random((500, 2)), [[1e9, -1e9]], [[1e9, -1e9]]],
    "ties": R.integers(0, 3, size=(600, 2)).astype(float),
    "flat column": np.c_[R.random(200), np.full(200, 7.0)],
}


def frame(spark, x):
    names = ", ".join(f"c{j} double" for j in range(x.shape[1]))
    rows = [(i, *map(float, r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "id long, " + names), [f"c{j}" for j in range(x.shape[1])]


def distances(x):
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    return d[np.triu_indices(len(x), 1)]


@pytest.mark.parametrize("name", SHAPES)
def test_diameter_is_exact(spark, name):
    df, cols = frame(spark, SHAPES[name])
    assert S.diameter(df, cols) == pytest.approx(distances(SHAPES[name]).max(), rel=1e-11)


def test_mean_within_its_stated_error(spark):
    x = SHAPES["cloud"]
    df, cols = frame(spark, x)
    want = distances(x)
    got = [S.mean_distance(df, cols, ["id"], seed=s).head() for s in range(6)]
    assert all(abs(g["pairs"] - 4 * len(x)) < 0.1 * 4 * len(x) for g in got)
    assert all(g["mean_error"] == pytest.approx(want.std() / np.sqrt(g["pairs"]), rel=0.1) for g in got)
    off = [(g["mean_distance"] - want.mean()) / g["mean_error"] for g in got]
    assert max(map(abs, off)) < 4 and np.sqrt(np.mean(np.square(off))) < 2


def test_edges(spark):
    df, cols = frame(spark, np.array([[1.0, 2.0], [4.0, 6.0]]))
    d = S.diversity(df, cols, ["id"]).head()
    assert (d["mean_distance"], d["max_distance"], d["diversity_score"]) == (5.0, 5.0, 1.0)
    same = S.diversity(df.filter("id = 0").union(df.filter("id = 0")), cols, ["id"]).head()
    assert same["max_distance"] == 0 and same["diversity_score"] == 1
    none = S.diversity(df.filter("id < 0"), cols, ["id"]).head()
    assert none["pairs"] == 0 and none["diversity_score"] == 1
    odd = spark.sql("SELECT * FROM VALUES (0, 1D, 1D), (1, NULL, 9D), (2, DOUBLE('NaN'), 1D), (3, 2D, 1D) AS t(id, c0, c1)")
    assert S.diameter(odd, cols) == 1.0
