"""Steps of c11 and d28 that run on every row are compiled columns, and
SMOTE's minority is made once."""

import bisect
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tabvet.operators import encode, generate, information, neighbours, ranks


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_bucket_search_counts_the_bounds_below(spark):
    r = random.Random(1)
    for n in (2, 3, 8, 9, 256):
        bounds = sorted(r.sample(range(1000), r.randrange(1, n)))
        values = [None, float("nan"), -5.0, 2000.0, *map(float, bounds), *[r.uniform(-1, 1001) for _ in range(200)]]
        df = spark.createDataFrame([(v,) for v in values], "v double").withColumn(
            "b", F.array(*[F.lit(float(x)) for x in bounds]))
        for v, got in ranks.with_bucket(df, "b", "v", n, "at").select("v", "at").collect():
            want = 0 if v is None else len(bounds) if math.isnan(v) else bisect.bisect_left(bounds, v)
            assert got == want


def test_running_sums_and_radii_have_no_lambda_per_row(spark):
    counts = spark.createDataFrame([(0, "a", float(i % 7), 1) for i in range(20)], "pair int, a string, v double, cnt long")
    assert "lambda" not in plan(ranks.cumulative(counts, ["pair"], "v", ["cnt"]))
    near = information.radii(counts.groupBy("pair", "a", "v").agg(F.sum("cnt").alias("cnt")), 3)
    assert "array_sort" not in plan(near) and "lambda" not in plan(near)


def test_radius_by_brute_force(spark):
    r = random.Random(4)
    rows = [(0, c, float(v), r.choice([1, 1, 1, 2, 3, 6])) for c in "abcd" for v in r.sample(range(60), {"a": 2, "b": 3}.get(c, 25))]
    rows += [(0, "e", 5.0, 9), (0, "f", float("inf"), 1), (0, "f", 1.0, 2)]
    counts = spark.createDataFrame(rows, "pair int, a string, v double, cnt long")
    for k in (1, 2, 3, 5):
        got = {(x.a, x.v): x.r for x in information.radii(counts, k).collect()}
        assert len(got) == len(rows)
        for _, c, v, n in rows:
            others = sorted([0.0] * (n - 1) + [abs(u - v) for _, d, u, m in rows if d == c and u != v for _ in range(m)])
            assert got[c, v] == others[min(k, len(others)) - 1]


def test_prepare_fills_what_is_not_finite_and_smote_makes_the_minority_once(spark):
    odd = [None, float("nan"), float("inf"), float("-inf")]
    rows = [(i, odd[i] if i < 4 else float(i), "P" if i % 4 == 0 else "O") for i in range(80)]
    df = spark.createDataFrame(rows, "k long, x double, c string")
    out, _ = encode.prepare(df, ["x"], "k")
    got = {r.k: r.x for r in out.collect()}
    assert all(got[i] == 41.5 for i in range(4)) and all(got[i] == i for i in range(4, 80))
    assert "isnan" not in plan(out).lower()
    grown, _ = encode.prepare(df, ["x"], "k", balance=("c", "P"))
    assert grown.filter("synthetic").count() == 40
    synthetic = plan(grown.filter("synthetic"))
    assert "LogicalRDD" in synthetic and "= P)" not in synthetic


def test_cell_search_keeps_ties_and_rows_that_complete_k():
    r = np.random.default_rng(0)
    for _ in range(150):
        m, q, k, span = (int(r.integers(1, x)) for x in (40, 30, 8, 12))
        base = pd.DataFrame({"a": r.integers(0, span, m) * 1.0, "b": r.integers(0, span, m) * 1.0, "_n": r.integers(1, 4, m)})
        base["_keys"] = [[i] for i in range(m)]
        asked = pd.DataFrame({"a": r.integers(0, span, q) * 1.0, "b": r.integers(0, span, q) * 1.0,
                              "_r": np.where(r.random(q) < 0.5, np.inf, r.random(q) * 5)})
        got = neighbours._nearest(asked, base, ["a", "b"], k, ["a", "b", "_d", "_n", "_keys"])
        want = []
        for x in asked.itertuples():
            held, last = 0, 0.0
            for d, i in sorted((math.sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2), y.Index) for y in base.itertuples()):
                if held >= k and d > last:
                    break
                held, last = held + base["_n"][i], d if held < k else last
                if d <= x[3]:
                    want.append((x.a, x.b, d, base["_n"][i], [i]))
        assert [tuple(x) for x in got.itertuples(index=False)] == want


def test_cell_search_does_not_sort_whole_cells(monkeypatch):
    sizes = []
    whole = np.argsort
    monkeypatch.setattr(np, "argsort", lambda a, *x, **y: sizes.append(np.size(a)) or whole(a, *x, **y))
    r = np.random.default_rng(1)
    base = pd.DataFrame({"a": r.random(1000), "_n": 1})
    neighbours._nearest(pd.DataFrame({"a": r.random(50), "_r": np.inf}), base, ["a"], 5, ["a", "_d", "_n"])
    assert max(sizes, default=0) < 50 * 1000
