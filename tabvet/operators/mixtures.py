"""Gaussian mixtures of several sizes fitted by EM side by side.

Start, update, floor of the densities and stopping rule are those of Spark's
``GaussianMixture``, the start with the rows it would draw.  Equal points are
one point with a count, and every round is one job over the points for all
mixtures that have not stopped: a task returns sums per component, so a round
sends components x features^2 numbers per task to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPSILON = 2.0 ** -52
#: Error of an exponent that rounding may make.
ROUNDED = 1e-11
#: Distinct points a task has, where there are more than cores.
TASK_POINTS = 500_000
#: Rows that Spark's GaussianMixture starts a component from.
START_ROWS = 5


@dataclass
class Mixture:
    """weights (k), means (k, d), covariances (k, d, d)."""
    weights: np.ndarray
    means: np.ndarray
    covs: np.ndarray
    log_likelihood: float = -np.finfo(float).max
    change: float = np.inf

    def whitening(self) -> tuple[np.ndarray, np.ndarray]:
        """Per component the matrix that makes its covariance the identity
        (a pseudo-inverse where it is singular) and the density's log factor."""
        d = self.means.shape[1]
        values, vectors = np.linalg.eigh(self.covs)
        used = values > EPSILON * values.max(1, keepdims=True) * d
        if not used.any(1).all():
            raise ValueError("a component's covariance matrix has no non-zero eigenvalue")
        safe = np.where(used, values, 1.0)
        roots = vectors * np.where(used, 1.0 / np.sqrt(safe), 0.0)[:, None, :]
        return roots, -0.5 * (d * np.log(2 * np.pi) + np.log(safe).sum(1))


def varied(df: DataFrame, cols: list[str], least: int) -> list[str]:
    """The columns with more than ``least`` distinct values.  A sketch of few
    values has as many registers, so one that tells of far more is certain and
    only the other columns are counted exactly."""
    def count(by, some):
        return dict(zip(some, df.agg(*[by(c) for c in some]).first())) if some else {}
    about = count(F.approx_count_distinct, cols if least <= 20 else [])
    sure = [c for c in about if about[c] > 100]
    exact = count(F.count_distinct, [c for c in cols if c not in sure])
    return [c for c in cols if c in sure or exact[c] > least]


def points(features: DataFrame, cols: list[str], rows: int) -> DataFrame:
    """(cols..., n): distinct points with their counts."""
    return features.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def packed(pts: DataFrame, cols: list[str], distinct: int) -> DataFrame:
    """``pts``, ``distinct`` or so, as one binary value for some 10,000 points
    (coordinates, then counts), spread over the cores, so a round reads them
    without unpacking rows."""
    spark = pts.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, -(-distinct // TASK_POINTS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x, n in _chunks(batches, cols, 10_000):
            yield pa.RecordBatch.from_arrays([pa.array([np.vstack([x, n]).tobytes()], pa.binary())], names=["points"])
    return pts.mapInArrow(pack, "points binary").repartition(tasks)


def starts(rows: DataFrame, sizes: list[int], seed: int, n: int | None = None) -> list[Mixture]:
    """Where Spark's GaussianMixture begins for each size, from the rows that
    it would draw of ``n``; a ``features`` column is left out."""
    cols = [c for c in rows.columns if c != "features"]
    drawn = rows.select(*cols)._jdf.toJavaRDD()
    n, out = rows.count() if n is None else n, []
    for k in sizes:
        x = np.array([[r.getDouble(i) for i in range(len(cols))] for r in _drawn(rows, drawn, START_ROWS * k, n, seed)])
        x = x.reshape(k, START_ROWS, len(cols))
        means = x.mean(1)
        out.append(Mixture(np.full(k, 1.0 / k), means, ((x - means[:, None]) ** 2).mean(1)[:, :, None] * np.eye(len(cols))))
    return out


def _drawn(rows: DataFrame, rdd, size: int, n: int, seed: int) -> list:
    """``RDD.takeSample`` with replacement, without counting the rows each time."""
    if not n:
        raise ValueError("no rows to start a mixture from")
    random = rows.sparkSession._jvm.java.util.Random(seed)
    fraction = (size + (12.0 if size < 6 else 9.0 if size < 16 else 6.0) * np.sqrt(size)) / n
    found: list = []
    while len(found) < size:
        found = list(rdd.sample(True, float(fraction), random.nextInt()).collect())
    for i in range(len(found) - 1, 0, -1):
        j = random.nextInt(i + 1)
        found[i], found[j] = found[j], found[i]
    return found[:size]


def _densities(mixtures: list[Mixture]):
    """Weighted densities of points (d x points) under all components, a row
    for each; they are overwritten by the next call.  The exponents are one
    product of the coordinates' monomials wherever rounding keeps that within
    ``ROUNDED``, else sums of squares."""
    weights = np.concatenate([m.weights for m in mixtures])
    means = np.concatenate([m.means for m in mixtures])
    roots, logs = (np.concatenate(x) for x in zip(*(m.whitening() for m in mixtures)))
    k, d = means.shape
    left, right = np.triu_indices(d)
    with np.errstate(divide="ignore"):
        logs = (logs + np.log(weights))[:, None]
    squares = roots.transpose(2, 0, 1) * np.sqrt(0.5)
    squares = np.concatenate([squares, -np.einsum("kd,ekd->ek", means, squares)[:, :, None]], 2).reshape(d * k, d + 1)
    middle, scale = means.mean(0), np.sqrt(np.mean([np.diag(c) for m in mixtures for c in m.covs], 0))
    scale = np.where(scale > 0, scale, 1.0)[:, None]
    at, inverse = (means - middle) / scale[:, 0], roots * scale * np.sqrt(0.5)
    inverse = inverse @ inverse.transpose(0, 2, 1)
    product = np.concatenate([logs - np.einsum("ki,kij,kj->k", at, inverse, at)[:, None], 2 * np.einsum("kij,kj->ki", inverse, at),
                              -inverse[:, left, right] * np.where(left == right, 1, 2)], 1)
    most = np.abs(product)
    kept: dict[int, np.ndarray] = {}

    def of(x: np.ndarray) -> np.ndarray:
        size = x.shape[1]
        if size not in kept:
            kept.clear()
            kept[size] = np.empty((k, size))
        p = kept[size]
        z = (x - middle[:, None]) / scale
        z = np.vstack([np.ones(size), z, z[left] * z[right]])
        if (most @ np.abs(z).max(1)).max() * EPSILON <= ROUNDED:
            np.matmul(product, z, out=p)
        else:
            y = squares @ np.vstack([x, np.ones(size)])
            y *= y
            np.subtract(logs, y[:k], out=p)
            for i in range(1, d):
                p -= y[i * k:(i + 1) * k]
        np.maximum(p, -600.0, out=p)  # far below EPSILON's last digit, and faster than numbers that vanish
        np.exp(p, out=p)
        p += EPSILON
        return p
    return of


def _chunks(batches: Iterator[pa.RecordBatch], cols: list[str], rows: int = 1024):
    """(points, d x rows at most; counts) of batches of points, packed or not."""
    for batch in batches:
        if batch.schema.names == ["points"]:
            blocks = (np.frombuffer(b.as_buffer()).reshape(len(cols) + 1, -1) for b in batch.column(0))
        else:
            blocks = [np.vstack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in (*cols, "n")])]
        for block in blocks:
            for i in range(0, block.shape[1], rows):
                yield block[:-1, i:i + rows], block[-1, i:i + rows]


def _expected(batches: Iterator[pa.RecordBatch], cols: list[str], mixtures: list[Mixture]) -> Iterator[pa.RecordBatch]:
    """One row of sums: log-likelihoods by mixture, then by component the
    shares, shares x point and shares x products of two coordinates."""
    of, d = _densities(mixtures), len(cols)
    left, right = np.triu_indices(d)
    sizes = [len(m.weights) for m in mixtures]
    edges = np.concatenate([[0], np.cumsum(sizes)])
    whole = np.repeat(np.eye(len(mixtures)), sizes, axis=1)
    likelihood, sums = np.zeros(len(mixtures)), np.zeros((edges[-1], 1 + d + len(left)))
    for x, n in _chunks(batches, cols):
        p = of(x)
        total = whole @ p
        likelihood += np.log(total) @ n
        np.divide(n, total, out=total)
        for part, a, b in zip(total, edges, edges[1:]):
            p[a:b] *= part
        sums += p @ np.vstack([np.ones(x.shape[1]), x, x[left] * x[right]]).T
    yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([likelihood, sums.ravel()]).tolist()])], names=["s"])


def _updated(m: Mixture, sums: np.ndarray, likelihood: float) -> Mixture:
    d = m.means.shape[1]
    left, right = np.triu_indices(d)
    share = sums[:, 0]
    means = sums[:, 1:1 + d] / share[:, None]
    covs = np.empty_like(m.covs)
    covs[:, left, right] = sums[:, 1 + d:] / share[:, None] - means[:, left] * means[:, right]
    covs[:, right, left] = covs[:, left, right]
    return Mixture(share / share.sum(), means, covs, likelihood, abs(likelihood - m.log_likelihood))


def fit(pts: DataFrame, cols: list[str], mixtures: list[Mixture], rounds: int = 100, tol: float = 0.01) -> list[Mixture]:
    """EM until a mixture's log-likelihood changes by at most ``tol``, or for
    ``rounds`` rounds; every round reads the points once."""
    fitted, d = list(mixtures), len(cols)
    width = 1 + d + d * (d + 1) // 2
    for _ in range(rounds):
        live = [i for i, m in enumerate(fitted) if m.change > tol]
        if not live:
            break
        asked = [fitted[i] for i in live]
        rows = pts.mapInArrow(lambda it, asked=asked: _expected(it, cols, asked), "s array<double>").collect()
        sums = np.sum([r["s"] for r in rows], axis=0)
        at = len(live)
        for j, i in enumerate(live):
            k = len(fitted[i].weights)
            fitted[i] = _updated(fitted[i], sums[at:at + k * width].reshape(k, width), float(sums[j]))
            at += k * width
    return fitted


def mode_counts(pts: DataFrame, cols: list[str], mixture: Mixture, name: str) -> DataFrame:
    """(m, ``name``): rows whose likeliest component is m."""
    def best(batches):
        of, found = _densities([mixture]), np.zeros(len(mixture.weights), np.int64)
        for x, n in _chunks(batches, cols):
            found += np.bincount(of(x).argmax(0), n, minlength=len(found)).astype(np.int64)
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int32()), pa.array(found[hit])], names=["m", "n"])
    return pts.mapInArrow(best, "m int, n long").groupBy("m").agg(F.sum("n").alias(name))
