"""Distributed kernels against pandas/NumPy brute force on small fixtures,
with chunk sizes forced tiny so the skew-splitting paths are exercised."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabvet.operators import profile as P
from tabvet.operators import sequence as S
from tabvet.operators.ranks import average_ranks, cumulative, sorted_gaps, value_counts

from conftest import SF_SMALL


def test_cumulative_and_ranks_match_pandas(spark):
    rng = np.random.default_rng(0)
    vals = rng.integers(0, 40, 500).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"g": rng.integers(0, 3, 500), "v": vals}))
    r = average_ranks(df, ["g"], "v", n_buckets=7).toPandas()
    pdf = df.toPandas()
    pdf["rank"] = pdf.groupby("g")["v"].rank(method="average")
    exp = pdf.groupby(["g", "v"])["rank"].first().reset_index()
    m = r.merge(exp, on=["g", "v"], suffixes=("", "_exp"))
    assert len(m) == len(exp)
    assert np.allclose(m["rank"], m["rank_exp"])


def test_text_values_keep_global_order(spark):
    words = ["b", "a", "ab", "abc", "zz", "z", "m", "ab", "b"] * 5
    df = spark.createDataFrame([(w,) for w in words], "v string")
    c = cumulative(value_counts(df, [], "v"), [], "v", n_buckets=4).orderBy("v").toPandas()
    assert list(c["cum_cnt"]) == list(np.cumsum(c["cnt"]))


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(1)
    x = np.round(rng.normal(10, 3, 333), 1)
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    probs = [0.0, 0.05, 0.25, 0.5, 0.75, 0.9, 1.0]
    got = {r["p"]: r["q"] for r in P.quantiles(df, [], "v", probs, n_buckets=5).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(x, p * 100))


def test_sorted_gaps(spark):
    x = [1.0, 3.0, 3.0, 7.0, 8.0, 20.0, 21.0]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    g = sorted(r["gap"] for r in sorted_gaps(df, [], "v", n_buckets=3).collect())
    assert g == sorted(np.diff(sorted(set(x))))


def test_golden_uniform_moments_and_tests(spark):
    df = spark.range(1, 50001).select(F.col("id").cast("double").alias("u"))
    prof = P.numeric_profile(df, ["u"]).first()
    assert prof["mean"] == pytest.approx(25000.5)
    assert prof["std"] == pytest.approx(14433.90106658626, rel=1e-12)
    assert prof["kurtosis"] == pytest.approx(-1.2000000009599996, rel=1e-9)
    ks = P.ks_normal(df, ["u"]).first()["ks_statistic"]
    assert ks == pytest.approx(0.057214399101341074, abs=1e-9)
    ad = P.anderson_darling(df, ["u"]).first()["anderson_statistic"]
    assert ad == pytest.approx(555.934168545893, rel=1e-7)


def test_categorical_golden(spark):
    df = spark.range(50000).select(F.col("id").cast("string").alias("s"))
    c = P.categorical_profile(df, ["s"]).first()
    assert c["entropy_bits"] == pytest.approx(15.60964040230206, rel=1e-9)
    assert c["gini"] == pytest.approx(0.99998)
    assert c["mode_share"] == pytest.approx(2e-05)


def _events(spark):
    return spark.read.parquet(f"{SF_SMALL}/events.parquet")


def test_row_index_and_lag_with_tiny_chunks(spark):
    e = _events(spark).select("event_id", "user_id", "value")
    got = S.with_lag(e, ["user_id"], ["event_id"], "value", "prev", rows_per_chunk=3).toPandas()
    pdf = e.toPandas().sort_values(["user_id", "event_id"])
    pdf["prev"] = pdf.groupby("user_id")["value"].shift(1)
    m = got.merge(pdf, on="event_id", suffixes=("", "_exp"))
    assert len(m) == len(pdf)
    assert ((m["prev"] == m["prev_exp"]) | (m["prev"].isna() & m["prev_exp"].isna())).all()


def test_rolling_with_tiny_chunks(spark):
    e = _events(spark).select("event_id", "event_type", "value")
    got = S.with_rolling(e, ["event_type"], ["event_id"], 5,
                         {"m": lambda w: F.avg("value").over(w)}, rows_per_chunk=6).toPandas()
    pdf = e.toPandas().sort_values(["event_type", "event_id"])
    pdf["m"] = pdf.groupby("event_type")["value"].transform(lambda s: s.rolling(5, min_periods=1).mean())
    m = got.merge(pdf, on="event_id", suffixes=("", "_exp"))
    assert len(m) == len(pdf)
    assert np.allclose(m["m"], m["m_exp"])


def test_prefix_min_with_tiny_chunks(spark):
    e = _events(spark).select("event_id", "event_type", "value")
    got = S.with_prefix(e, ["event_type"], ["event_id"], "value", "best", "min", rows_per_chunk=5).toPandas()
    pdf = e.toPandas().sort_values(["event_type", "event_id"])
    pdf["best"] = pdf.groupby("event_type")["value"].transform(lambda s: s.cummin().shift(1))
    m = got.merge(pdf, on="event_id", suffixes=("", "_exp"))
    ok = (m["best"] == m["best_exp"]) | (m["best"].isna() & m["best_exp"].isna())
    assert ok.all()
