"""B2/B14 moments and D16 positions at the cost of one step a row."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabvet.operators import encode as E
from tabvet.operators import profile as P


def test_moments_by_sums_of_powers(spark):
    r = np.random.default_rng(2)
    xs = (1e6 + r.exponential(3.0, 500)).tolist() + [None, float("inf"), float("-inf"), float("nan")]
    rows = [(x, 0.1, None, float(i) if i == 3 else None) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "x double, same double, none double, one double")
    prof = P.numeric_profile(df)
    got = {row["feature"]: row for row in prof.collect()}
    x = np.array(xs[:500])
    d = x - x.mean()
    g = got["x"]
    assert g["n_rows"] == 504 and g["non_null"] == 502 and g["n_inf"] == 2 and g["unique_count"] == len(set(xs[:500])) + 2
    assert g["missing_rate"] == pytest.approx(2 / 504)
    assert g["mean"] == pytest.approx(x.mean()) and g["std"] == pytest.approx(x.std(ddof=1), rel=1e-9)
    assert g["skewness"] == pytest.approx((d ** 3).mean() / (d ** 2).mean() ** 1.5, rel=1e-9)
    assert g["kurtosis"] == pytest.approx((d ** 4).mean() / (d ** 2).mean() ** 2 - 3, rel=1e-9)
    want = df.select("same", "one").agg(*[f(c).alias(f"{c}{n}") for c in ("same", "one") for n, f in (
        ("std", F.stddev_samp), ("skewness", F.skewness), ("kurtosis", F.kurtosis))]).first()
    for c in ("same", "one"):
        assert all(got[c][n] == want[c + n] for n in ("std", "skewness", "kurtosis"))
    assert got["none"]["non_null"] == 0 and got["none"]["mean"] is None and got["none"]["std"] is None
    assert P.numeric_profile(df.limit(0)).count() == 0


def test_moments_carry_no_distinct_values(spark):
    prof = P.numeric_profile(spark.range(10).withColumn("x", F.col("id") * 0.5), ["x"])
    plan = P.jarque_bera(prof)._jdf.queryExecution().optimizedPlan().toString()
    assert "distinct" not in plan and "kurtosis(" not in plan and "skewness(" not in plan


@pytest.mark.parametrize("n", [5, 32, 1000])
def test_positions_are_found_once_a_row(spark, n):
    df = spark.createDataFrame([(i, None if i == 7 else f"Customer#{i}") for i in range(40)], "id long, v string")
    placed, h = E.feature_hashing(df, "v", n)
    out = placed.select("id", "v", *[c.alias(k) for k, c in h.items()])
    assert out._jdf.queryExecution().optimizedPlan().toString().count("md5(") <= 5
    for row in out.collect():
        want = [0.0] * n
        if row["v"] is not None:
            big = int(hashlib.md5(row["v"].encode()).hexdigest(), 16)
            want[big % n] = 1.0 if big // n % 2 == 0 else -1.0
        assert list(row[2:]) == want and math.fsum(map(abs, want)) <= 1
