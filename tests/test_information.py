"""Nearest-neighbour mutual information against a row-by-row version."""

import math
import random

import pytest

from tabvet.operators import information as I
from tabvet.operators import relations as R

EULER = 0.5772156649015329


def brute_force(rows: list[tuple], k: int = 3) -> float:
    """The estimate row by row, for tests."""
    psi = [None, -EULER]
    rows = [(a, float(v)) for a, v in rows if a is not None and v is not None and not math.isnan(v)]
    classes: dict = {}
    for a, v in rows:
        classes.setdefault(a, []).append(v)
    rows = [(a, v) for a, v in rows if len(classes[a]) > 1]
    while len(psi) <= len(rows) + 1:
        psi.append(psi[-1] + 1 / (len(psi) - 1))
    total = 0.0
    for a, v in rows:
        kc = min(k, len(classes[a]) - 1)
        r = sorted(abs(v - u) for u in classes[a])[kc]
        m = sum(v - r < u < v + r for _, u in rows) if r > 0 else sum(u == v for _, u in rows)
        total += psi[kc] - psi[len(classes[a])] - psi[max(m, 1)]
    return max(0.0, psi[len(rows)] + total / len(rows)) if rows else 0.0


def table(seed, n, classes, values):
    r = random.Random(seed)
    out = []
    for _ in range(n):
        a = r.choice(classes)
        v = values(r, a)
        out.append((None if r.random() < 0.03 else a, None if r.random() < 0.03 else v))
    return out


CASES = {
    "ties": table(1, 2000, "abc", lambda r, a: float(r.randint(0, 30) + "abc".index(a) * 5)),
    "distinct": table(2, 1500, "ab", lambda r, a: r.gauss("ab".index(a) * 1.5, 1)),
    "one value": [("a", 1.0)] * 5 + [("b", 1.0)] * 4,
    "single rows": [("a", 1.0), ("b", 2.0), ("c", 3.0)],
    "small classes": [("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", 7.0), ("c", 9.0), ("d", float("nan"))],
    "nothing": [(None, 1.0), ("a", None)],
    "hot value": [("a", 0.0)] * 900 + [("b", 0.0)] * 500 + table(3, 500, "ab", lambda r, a: float(r.randint(-4, 4))),
    "many classes": [(str(k // 3), float(k * 7 % 101)) for k in range(600)],
}


@pytest.mark.parametrize("name", CASES)
def test_against_row_by_row(spark, monkeypatch, name):
    monkeypatch.setattr(I, "CHUNK", 16)
    rows = CASES[name]
    df = spark.createDataFrame(rows, "a string, v double")
    got = I.neighbour_information(df, [("a", "v")]).collect()
    assert [(r.col1, r.col2) for r in got] == [("a", "v")]
    assert got[0].mi == pytest.approx(brute_force(rows), abs=1e-9)


def test_pairs_of_one_table_and_empty_table(spark):
    rows = [(x[0], y[0], x[1]) for x, y in zip(CASES["ties"], CASES["distinct"])]
    df = spark.createDataFrame(rows, "a string, b string, v double")
    got = {(r.col1, r.col2): r.mi for r in I.neighbour_information(df, [("a", "v"), ("b", "v")]).collect()}
    assert got["a", "v"] == pytest.approx(brute_force([(a, v) for a, _, v in rows]), abs=1e-9)
    assert got["b", "v"] == pytest.approx(brute_force([(b, v) for _, b, v in rows]), abs=1e-9)
    assert I.neighbour_information(df.limit(0), [("a", "v")]).first().mi == 0.0


def test_no_pair_of_rows_is_compared(spark):
    df = spark.createDataFrame(CASES["ties"], "a string, v double")
    plan = I.neighbour_information(df, [("a", "v")])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_matrix_scores_mixed_pairs_by_neighbours(spark):
    rows = [(a, v, str(k % 2)) for k, (a, v) in enumerate(CASES["distinct"])]
    df = spark.createDataFrame(rows, "a string, v double, other string")
    got = {(r.col1, r.col2): (r.kind, r.score) for r in R.relationship_matrix(df, ["a", "v", "other"]).collect()}
    want = min(brute_force(CASES["distinct"]) / 2, 1.0)
    assert want > 0.08 > got["v", "other"][1]
    assert got["a", "v"] == got["v", "a"] == ("mutual_info", pytest.approx(want, abs=1e-9))
