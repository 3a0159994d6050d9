"""Dependent synthesis: association kept, fall-back, NULLs, dates, ties."""

import datetime as dt
import random

import pytest

from tabvet.operators import dependent as D
from tabvet.operators import generate as G
from tabvet.operators import relations as R


@pytest.fixture(scope="module")
def real(spark):
    r = random.Random(3)
    rows = []
    for _ in range(3000):
        a = r.choice("xxxyz")
        b = a + "1" if r.random() < 0.8 else r.choice(["x1", "y1", "z1"])
        num = r.gauss({"x": -50, "y": 0, "z": 60}[a], 3)
        day = dt.datetime(2020, 1, 1) + dt.timedelta(days=(300 if b == "z1" else 0) + r.randint(0, 90))
        rows.append((a, None if r.random() < 0.1 else b, num, r.randint(1, 4) * (2 if num > 0 else 1), day, day.date()))
    return spark.createDataFrame(rows, "a string, b string, num double, whole int, at timestamp, day date")


def synth(spark, real, **kw):
    names = ["a", "b", "num", "whole", "at", "day"]
    edges = [("a", "b", 0.8), ("a", "num", 0.9), ("num", "whole", 0.5), ("b", "at", 0.6), ("a", "at", 0.2), ("at", "day", 1.0)]
    return D.dependent_synthesis(spark, real, kw.pop("n", 3000), edges, ["a", "b"], ["num", "whole"], ["at", "day"], **kw).select(
        "row_id", *names)


def test_association_is_kept(spark, real):
    got = synth(spark, real).cache()
    assert got.count() == 3000 and [f.dataType for f in got.schema[1:]] == [f.dataType for f in real.schema]
    banded = [d.selectExpr("a", "coalesce(b, 'none') b", "CAST(num > -20 AS string) sign", "CAST(day > DATE'2020-06-01' AS string) late")
              for d in (real, got)]
    pairs = [("a", "b"), ("a", "sign"), ("b", "late"), ("a", "late")]
    one, two = ({(r.col1, r.col2): r.cramers_v for r in R.cramers_v(d, pairs).collect()} for d in banded)
    for p in pairs:
        assert two[p] == pytest.approx(one[p], abs=0.07), p
    assert one["a", "b"] > 0.6 and one["b", "late"] > 0.8
    # drawn on their own, the same columns are independent
    alone = D.dependent_synthesis(spark, real, 3000, [], ["a", "b"])
    assert R.cramers_v(alone.selectExpr("a", "coalesce(b, 'none') b"), [("a", "b")]).first().cramers_v < 0.1
    x, y = (d.selectExpr("avg(CAST(b IS NULL AS int)) nulls", "min(num) lo", "max(num) hi", "min(at) early",
                         "max(at) last", "avg(num) mean").first() for d in (real, got))
    assert y.nulls == pytest.approx(x.nulls, abs=0.03) and y.mean == pytest.approx(x.mean, abs=2.5)
    assert x.lo <= y.lo and y.hi <= x.hi and x.early <= y.early and y.last <= x.last
    # numbers keep their gap between two modes
    assert got.filter("num BETWEEN 20 AND 40").count() < 60 and got.filter("num > 40").count() > 400


def test_same_seed_same_rows(spark, real):
    a, b = (sorted(D.dependent_synthesis(spark, r, 200, [("a", "num", 1.0)], ["a"], ["num"], seed=5).collect())
            for r in (real, real.repartition(5)))
    assert a == b


def test_unseen_configurations_fall_back(spark):
    coded = spark.createDataFrame([("=p", "=q", "=1")] * 5 + [("=p", "=r", "=2")] * 5 + [("=s", "=q", "=3")] * 5,
                                  "a string, b string, c string")
    rows = spark.createDataFrame([(0, "=s", "=r"), (1, "=t", "=q"), (2, "=p", "=r"), (3, "=s", "=q")],
                                 "row_id long, a string, b string")
    got = {r.row_id: r.c for r in D.draw_child(rows, coded, "c", ["a", "b"], 1).collect()}
    assert got[0] == "=3" and got[2] == "=2" and got[3] == "=3" and got[1] in ("=1", "=2", "=3")


def test_configurations_do_not_run_together(spark):
    coded = spark.createDataFrame([("=ab", "=c", "=1"), ("=a", "=bc", "=2")], "a string, b string, c string")
    rows = spark.createDataFrame([(0, "=ab", "=c"), (1, "=a", "=bc")], "row_id long, a string, b string")
    assert [r.c for r in D.draw_child(rows, coded, "c", ["a", "b"], 1).orderBy("row_id").collect()] == ["=1", "=2"]


def test_texts_like_codes_constants_and_empty_tables(spark):
    df = spark.createDataFrame([("null", 1.0, None), (None, 1.0, None)] * 20, "t string, one double, none double")
    got = D.dependent_synthesis(spark, df, 100, [("t", "one", 1.0)], ["t"], ["one", "none"]).collect()
    assert {r.t for r in got} == {"null", None} and {r.one for r in got} == {1.0} and {r.none for r in got} == {None}
    gone = D.dependent_synthesis(spark, df.limit(0), 5, [], ["t"], ["one"]).collect()
    assert [(r.t, r.one) for r in gone] == [(None, None)] * 5


def test_graph():
    parents = D.parents_of(["a", "b", "c"], [("a", "c", 0.2), ("b", "c", 0.9), ("x", "c", 1.0), ("a", "b", 0.5)], 1)
    assert parents == {"a": [], "b": ["a"], "c": ["b"]} and D.drawing_order(parents) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="cycle"):
        D.drawing_order({"a": ["b"], "b": ["a"]})


def test_hot_group_of_many_categories(spark):
    """A group's categories lie in many ranges, not in one window."""
    df = spark.range(50_000).selectExpr("'hot' g", "concat('c', id) v")
    t = G.categorical_table(df, "v", ["g"])
    got = t.selectExpr("count(*) n", "sum(_hi - _lo) s", "max(_hi) hi", "min(_lo) lo", "count(DISTINCT _lo) starts").first()
    assert tuple(got) == (50_000, 50_000, 50_000, 0, 50_000)
    assert "_bucket" in t._jdf.queryExecution().toString()
