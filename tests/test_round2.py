"""Whole-table rules, storage rule, text ranges and stateful definitions."""

import random

import pytest
from pyspark.sql import functions as F

from tabvet import session
from tabvet.operators import heal, metriclog, powerlaw as PL, privacy, profile, ranks, rules


def test_shared_folder_is_asked_for_on_a_cluster():
    for master in ("local", "local[*]", "local[4]", "local[4, 2]"):
        session.require_local(master)
    for master in ("yarn", "spark://host:7077", "k8s://host", "local-cluster[3,2,1024]"):
        with pytest.raises(ValueError):
            session.require_local(master)


def test_prefixed_texts_spread_over_buckets(spark):
    df = spark.range(5000).select(F.format_string("Customer#%09d", "id").alias("v"))
    counts = ranks.value_counts(df, [], "v").withColumn("_all", F.lit(0))
    bounds = ranks._text_bounds(counts, ["_all"], "v", 64).head()["_bounds"]
    assert len(bounds) == 63 and bounds == sorted(bounds)
    got = ranks.cumulative(ranks.value_counts(df, [], "v"), [], "v", "cnt", 64).orderBy("v").collect()
    assert [r["cum_cnt"] for r in got] == list(range(1, 5001))


def _log(spark, values):
    rows = [("m", i, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "metric string, ts long, value double")


def _stop(values, patience, delta, mode):
    best, waited = None, 0
    for i, v in enumerate(values, 1):
        if best is None or (v < best - delta if mode == "min" else v > best + delta):
            best, waited = v, 0
        else:
            waited += 1
        if waited >= patience:
            return i
    return None


@pytest.mark.parametrize("mode", ["min", "max"])
def test_early_stop_is_the_stateful_rule(spark, mode):
    r = random.Random(1)
    step = -0.00005 if mode == "min" else 0.00005
    cases = [[1 + i * step for i in range(40)], [r.random() for _ in range(60)],
             [1 + i * step * r.random() * 3 for i in range(60)], [1.0] * 15]
    for values in cases:
        got = metriclog.early_stop_point(_log(spark, values), 10, 1e-4, ["ts"], mode, rows_per_chunk=16).collect()
        want = _stop(values, 10, 1e-4, mode)
        assert ([x["stop_position"] for x in got] or [None]) == [want]


@pytest.mark.parametrize("n", [9, 10, 11, 14, 16, 17, 40])
def test_retention_is_trimming_reading_by_reading(spark, n):
    held = []
    for i in range(n):
        held.append(i)
        if len(held) > 10:
            held = held[-5:]
    got = metriclog.retention(_log(spark, range(n)), 10, 5, ["ts"]).collect()
    assert sorted(r["ts"] for r in got) == held


def test_temporal_detection_reads_all_rows(spark):
    rows = [(i, "2024-01-0%d" % (1 + i % 9) if i < 150 else "n/a", "x" if i else "2024-01-01") for i in range(300)]
    got = {r["feature"]: r["is_temporal"] for r in
           profile.temporal_detect(spark.createDataFrame(rows, "id long, a string, b string"), "id").collect()}
    assert got == {"a": True, "b": False}


def test_pattern_overlap_is_whole(spark):
    real = spark.createDataFrame([(i, None if i % 2 else "a") for i in range(100)], "x long, y string")
    got = privacy.rare_pattern_overlap(real, real.filter("x < 25"), ["x", "y"]).head()[0]
    assert got == 0.25
    assert privacy.rare_pattern_overlap(real.filter("x < 0"), real, ["x", "y"]).head()[0] == 0.0


def test_power_law_looks_at_all_frequencies(spark):
    # more distinct frequencies than any fixed number of top ones would show
    df = spark.range(1, 1500).select("id", F.explode(F.sequence(F.lit(1), (F.lit(3000) / F.col("id")).cast("int") + 1)).alias("k"))
    fit = PL.power_law_fit(df, "id").head()
    assert fit["is_power_law"] and fit["n_tail"] >= 100


def test_then_inside_quotes():
    tree = rules.parse_rule("IF a = 'x THEN y' THEN b > 1")
    assert tree[0] == "if" and tree[2] == ("cmp", "b", ">", ("num", 1))


def test_groups_by_kind_and_stem(spark):
    import math
    rows = [(math.sin(2 * math.pi * (i % 7) / 7), math.cos(2 * math.pi * (i % 7) / 7), 2020.0, 1.0, 2.0,
             float(i % 2), float(1 - i % 2), 5.0, 6.0, 0.3, 0.4) for i in range(60)]
    df = spark.createDataFrame(rows, ["wk_sin", "wk_cos", "d_year", "d_month", "d_day", "s_F", "s_O", "q_a", "q_b",
                                      "dow_sin", "dow_cos"])
    got = heal.detect_groups(df)
    assert [(g.kind, g.columns, g.period) for g in got] == [
        ("cyclic", ("wk_sin", "wk_cos"), 7.0), ("cyclic", ("dow_sin", "dow_cos"), 7.0),
        ("datetime", ("d_year", "d_month", "d_day"), None), ("onehot", ("s_F", "s_O"), None)]


def test_repair_only_where_asked(spark):
    df = spark.createDataFrame([(1, 0.2, 0.9), (2, 0.2, 0.9)], "id long, s_a double, s_b double")
    got = heal.repair_groups(df, [heal.Group("onehot", ("s_a", "s_b"))], only=F.col("id") == 1).orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 0.0, 1.0), (2, 0.2, 0.9)]


def test_kendall_of_continuous_columns(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    from tabvet.operators import fidelity
    r = np.random.default_rng(0)
    x = r.normal(size=700)
    df = pd.DataFrame({"a": x, "b": x + r.normal(size=700), "c": np.round(x), "d": r.integers(0, 4, 700).astype(float)})
    monkeypatch.setattr(fidelity, "KENDALL_CELLS", 40)          # many ranges
    got = {(k["col1"], k["col2"]): k["kendall_tau_b"] for k in
           fidelity.kendall_matrix(spark.createDataFrame(df), list("abcd")).collect()}
    for (i, j), tau in got.items():
        u, v = (np.sign(df[k].to_numpy()[:, None] - df[k].to_numpy()[None, :]) for k in (i, j))
        want = (u * v).sum() / np.sqrt((u != 0).sum() * (v != 0).sum())
        assert abs(tau - want) < 1e-12
    assert len(got) == 6


def _brute_neighbours(points, k):
    out = {}
    for a, pa in points:
        near = sorted((sum((x - y) ** 2 for x, y in zip(pa, pb)) ** 0.5, b) for b, pb in points if b != a)
        out[a] = near[:k]
    return out


@pytest.mark.parametrize("cells", [8, 1000])
def test_neighbours_of_clustered_and_equal_points(spark, monkeypatch, cells):
    from tabvet.operators import neighbours
    monkeypatch.setattr(neighbours, "CELL_POINTS", cells)
    r = random.Random(2)
    rows = [(i, (1.0, 2.0)) for i in range(360)] + [(360, (1e9, -1e9))]
    rows += [(361 + i, (r.gauss(0, 1), r.gauss(0, 1))) for i in range(39)]
    df = spark.createDataFrame([(i, *p) for i, p in rows], "id long, a double, b double")
    want = _brute_neighbours(rows, 3)
    got = {}
    for x in privacy.knn_pairs(df, ["a", "b"], "id", 3).collect():
        got.setdefault(x["id"], {})[x["rank"]] = (x["distance"], x["neighbor"])
    assert {i: [v[k] for k in sorted(v)] for i, v in got.items()} == {
        i: [(pytest.approx(d, rel=1e-12), b) for d, b in v] for i, v in want.items()}
    kth = {x["id"]: x["kth_distance"] for x in privacy.knn(df, df, ["a", "b"], "id", 3, exclude_self="id").collect()}
    assert kth == {i: pytest.approx(v[-1][0], rel=1e-12) for i, v in want.items()}


def test_neighbours_with_fewer_base_rows_than_k(spark):
    base = spark.createDataFrame([(0.0, 0.0), (3.0, 4.0)], "a double, b double")
    query = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0)], "id long, a double, b double")
    got = sorted(tuple(x) for x in privacy.knn(query, base, ["a", "b"], "id", 5).collect())
    assert got == [(1, 5.0, 2.5), (2, 5.0, 2.5)]


def test_wide_categories_become_label_codes(spark):
    from tabvet.operators import encode
    df = spark.createDataFrame([(i, f"v{i % 60:02d}", "ab"[i % 2]) for i in range(120)], "id long, many string, few string")
    enc = encode.OneHotEncoder(["many", "few"]).fit(df)
    out = enc.transform(df)
    assert out.columns == ["id", "few_0", "few_1", "many_code"]
    back = {r["id"]: (r["many"], r["few"]) for r in enc.inverse(out).collect()}
    assert back == {i: (f"v{i % 60:02d}", "ab"[i % 2]) for i in range(120)}


def test_power_law_categories_get_their_type(spark):
    from tabvet.operators import typing as ty
    r = random.Random(11)
    sizes = [max(12, round(12 * r.random() ** (-1 / 1.6))) for _ in range(300)]
    sizes = [min(s, 3000) for s in sizes]
    df = spark.createDataFrame([(f"word {chr(97 + i % 26)}{i}", s) for i, s in enumerate(sizes)], "w string, n int") \
        .select("w", F.explode(F.sequence(F.lit(1), "n")).alias("k")).withColumn("u", F.format_string("name %05d", F.col("k") % 500))
    got = {x["feature"]: x["deep_type"] for x in ty.deep_types(df, ["w"]).collect()}
    assert got == {"w": "CATEGORICAL_POWER_LAW"}
    flat = spark.range(6000).select(F.format_string("name %03d", F.col("id") % 300).alias("v"))
    assert ty.deep_types(flat, ["v"]).first()["deep_type"] == "CATEGORICAL_HIGH_CARDINALITY"
