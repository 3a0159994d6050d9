"""Power-law fits by blocks against every candidate and every frequency."""

import numpy as np
import pytest

from tabvet.operators import powerlaw as PL


def distance(x, m, k):
    """(ks, alpha, n_tail) of candidate x[k]; x ascending."""
    t, w = x[k:].astype(float), m[k:]
    n = w.sum()
    s = (w * np.log(t)).sum() - n * np.log(t[0])
    if s <= 0:
        return np.inf, np.nan, n
    alpha = 1 + n / s
    return np.abs(w.cumsum() / n - (1 - (t / t[0]) ** (1 - alpha))).max(), alpha, n


def brute(x, m, min_n_tail=100, share=0.05):
    tails = m[::-1].cumsum()[::-1]
    found = [(*distance(x, m, k), x[k]) for k in range(len(x)) if tails[k] >= min_n_tail and tails[k] / m.sum() >= share]
    found = [f for f in found if np.isfinite(f[0])]
    return min(found, key=lambda f: (f[0], f[3])) if found else None


R = np.random.default_rng(11)


def spectrum(values):
    x, m = np.unique(values.astype(np.int64), return_counts=True)
    return x, m


SPECTRA = {
    "power": spectrum(np.floor(5 * R.random(20_000) ** (-1 / 1.3))), "uniform": spectrum(R.integers(1, 800, 4_000)),
    "body and tail": spectrum(np.concatenate([R.integers(1, 60, 6_000), np.floor(60 * R.random(5_000) ** (-1 / 1.8))])),
    "one": (np.array([7]), np.array([500])), "few": (np.array([1, 2, 9]), np.array([90, 5, 4])), "two": (np.array([1, 5]), np.array([300, 90])),
    "lognormal": spectrum(np.ceil(np.exp(R.normal(3, 1.2, 8_000)))),
}


@pytest.fixture(scope="module")
def fitted(spark):
    rows = [(k, int(a), int(b)) for k, (x, m) in SPECTRA.items() for a, b in zip(x, m)]
    return {r.feature: r for r in PL.fit_counts(spark.createDataFrame(rows, "feature string, x long, m long")).collect()}


@pytest.mark.parametrize("name", SPECTRA)
def test_same_as_all_candidates(fitted, name):
    want, got = brute(*SPECTRA[name]), fitted[name]
    assert got.support_size == SPECTRA[name][1].sum()
    if want is None:
        assert got.x_min is None and got.ks is None
    else:
        assert got.x_min == want[3] and got.n_tail == want[2]
        assert (got.ks, got.alpha) == (pytest.approx(want[0], abs=1e-12), pytest.approx(want[1], abs=1e-9))


def test_many_distinct_frequencies(spark):
    x = np.unique(np.floor(3 * R.random(330_000) ** (-1 / 0.7)).astype(np.int64))
    x = np.unique(np.concatenate([x, np.arange(1, 100_001) * 3]))[:100_000]
    m = np.maximum(1, (1e7 / x ** 0.8).astype(np.int64))
    table = spark.createDataFrame(__import__("pandas").DataFrame({"feature": "f", "x": x, "m": m})).repartition(8)
    fit = PL.fit_counts(table)
    assert "NestedLoop" not in fit._jdf.queryExecution().toString()
    got = fit.first()
    k = int(np.searchsorted(x, got.x_min))
    assert distance(x, m, k)[0] == pytest.approx(got.ks, abs=1e-9)
    tails = m[::-1].cumsum()[::-1] / m.sum()
    near = np.unique(np.concatenate([R.integers(0, len(x), 200), np.arange(max(0, k - 50), k + 50)]))
    assert all(distance(x, m, j)[0] >= got.ks - 1e-12 for j in near if tails[j] >= 0.05)


def test_all_columns_in_one_fit(spark):
    df = spark.range(20_000).selectExpr("CAST(floor(pow((id % 997 + 1) / 998D, -1.5)) AS string) a", "id % 50 b", "CAST(NULL AS double) c",
                                        "IF(id % 2 = 0, 0D, -0D) d")
    got = {r.feature: r for r in PL.power_law_fits(df, ["a", "b", "c", "d"]).collect()}
    assert got["b"].support_size == 50 and got["d"].support_size == 1 and not got["c"].is_power_law
    for c in "ab":
        alone = PL.power_law_fit(df, c).first()
        assert alone == got[c]
