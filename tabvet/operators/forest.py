"""Random forests of two classes grown from counts.

A tree of Spark's ``RandomForestClassifier`` sees a row only by its features'
bins, its class and how often the bootstrap drew it.  Rows of one class with
the same bins are therefore counted as a cell, and a tree's draws of a cell,
a Poisson(1) draw a row there, are one Poisson(rows) draw.  Bins, gain, leaves,
merged leaves and votes are Spark's; the bounds of the bins come from weighted
quantiles of all rows (within 1 / 2,048 of a task's weight) instead of some
10,000 drawn ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BINS = 32
#: Cells up to which forests are grown on the driver.
MOST_CELLS = 4096
#: Values a task tells of a column, and the rows it holds at once for it.
TOLD, HELD = 2048, 1 << 21
#: Trees grown side by side.
TREES = 25


def _columns(batches: Iterator[pa.RecordBatch], cols: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """label, one bit a forest for the rows it learns from, features."""
    for b in batches:
        yield (b.column("label").to_numpy().astype(np.int64), b.column("parts").to_numpy().astype(np.int64),
               *(b.column(c).to_numpy() for c in cols))


def _told(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """(value; weight) of sorted values: all that differ, or TOLD quantiles."""
    first = np.flatnonzero(np.diff(values, prepend=np.nan) != 0)
    if len(first) <= TOLD:
        return np.vstack([values[first], np.add.reduceat(weights, first)]) if len(first) else np.empty((2, 0))
    below = np.cumsum(weights)
    at = np.searchsorted(below, (np.arange(TOLD) + 0.5) / TOLD * below[-1])
    return np.vstack([values[at], np.full(TOLD, below[-1] / TOLD)])


def bounds(data: DataFrame, cols: list[str], weights: list[float], forests: int) -> list[list[np.ndarray]]:
    """By forest and column the upper bounds of all bins but the last, from the
    rows that the forest learns from (``parts``)."""
    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(held):
            label, parts, *features = (np.concatenate(x) for x in zip(*held))
            for j, v in enumerate(features):
                order = np.argsort(v)
                w, p, v = np.array(weights)[label[order]], parts[order], v[order]
                for i in range(forests):
                    own = (p >> i) & 1 == 1
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array(
                        [np.ascontiguousarray(_told(v[own], w[own])).tobytes()], pa.binary())], names=["i", "j", "told"])
        held, n = [], 0
        for x in _columns(batches, cols):
            held.append(x)
            n += len(x[0])
            if n >= HELD:
                yield from rows(held)
                held, n = [], 0
        if held:
            yield from rows(held)
    told: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in data.mapInArrow(tell, "i int, j int, told binary").collect():
        told.setdefault((r["i"], r["j"]), []).append(np.frombuffer(r["told"]).reshape(2, -1))
    return [[_splits(np.concatenate(told.get((i, j), [np.empty((2, 0))]), axis=1)) for j in range(len(cols))]
            for i in range(forests)]


def _splits(told: np.ndarray) -> np.ndarray:
    """Spark's choice of splits from values with weights: between all of them if
    they are few, else as near to equal weights as each bound can be."""
    values, at = np.unique(told[0], return_inverse=True)
    middles = (values[:-1] + values[1:]) / 2
    if len(middles) < BINS:
        return middles
    below = np.cumsum(np.bincount(at, told[1]))
    stride, out = below[-1] / BINS, []
    target = stride
    for i, middle in enumerate(middles):
        if abs(below[i] - target) < abs(below[i + 1] - target):
            out.append(middle)
            target += stride
    return np.array(out)


def cells(splits: list[np.ndarray]) -> int:
    return math.prod(len(s) + 1 for s in splits)


def counts(data: DataFrame, cols: list[str], splits: list[list[np.ndarray]]) -> list[np.ndarray]:
    """By forest the rows (held back or learnt from, class, cell)."""
    edges = np.concatenate([[0], np.cumsum([4 * cells(s) for s in splits])])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(edges[-1], np.int64)
        for label, parts, *features in _columns(batches, cols):
            for i, own in enumerate(splits):
                at = ((parts >> i) & 1) * 2 + label
                for s, v in zip(own, features):
                    at = at * (len(s) + 1) + np.searchsorted(s, v)
                found[edges[i]:edges[i + 1]] += np.bincount(at, minlength=edges[i + 1] - edges[i])
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit), pa.array(found[hit])], names=["at", "n"])
    total = np.zeros(edges[-1], np.int64)
    for r in data.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        total[r["at"]] = r["n"]
    return [total[a:b].reshape(2, 2, -1) for a, b in zip(edges, edges[1:])]


def votes(learnt: np.ndarray, shape: list[int], weights: list[float], trees: int, depth: int, seed: int) -> np.ndarray:
    """By cell the trees' summed shares of class 1; ``learnt``: rows (class, cell)."""
    random = np.random.default_rng(seed)
    bins = np.array(np.unravel_index(np.arange(learnt.shape[1]), shape))
    few = len(shape) if trees == 1 else int(np.ceil(np.sqrt(len(shape))))
    total = np.zeros(learnt.shape[1])
    for begin in range(0, trees, TREES):
        drawn = random.poisson(learnt, (min(TREES, trees - begin), *learnt.shape))
        for share in grown(drawn, bins, shape, weights, depth, few, random):
            total += share
    return total


def _gini(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = np.where(a + b > 0, a + b, 1.0)
    return np.where(a + b > 0, 1.0 - (a / n) ** 2 - (b / n) ** 2, 0.0)


def grown(drawn: np.ndarray, bins: np.ndarray, shape: list[int], weights: list[float], depth: int, few: int,
          random: np.random.Generator) -> np.ndarray:
    """(tree, cell): share of class 1 in the cell's leaf; ``drawn``: (tree,
    class, cell).  All trees grow a level at a time."""
    trees, _, size = drawn.shape
    weighted = drawn * np.array(weights)[None, :, None]
    node = np.zeros((trees, size), np.int64)  # of each cell, numbered within its level
    at, stats, inner = [node], [], []
    live = np.ones((trees, 1), bool)
    first = np.arange(trees)[:, None]
    for level in range(depth + 1):
        width = 1 << level
        index = (first * width + node).ravel()
        stats.append(np.stack([np.bincount(index, weighted[:, c].ravel(), trees * width) for c in (0, 1)]).reshape(2, trees, width))
        if level == depth:
            break
        a, b = stats[-1]
        weight, impurity = a + b, _gini(a, b)
        allowed = random.random((trees, width, len(shape))).argsort(2).argsort(2) < few if few < len(shape) else None
        best, feature, split = np.full((trees, width), -np.inf), np.zeros((trees, width), int), np.zeros((trees, width), int)
        for f, n in enumerate(shape):
            if n < 2:
                continue
            by = index * n + np.broadcast_to(bins[f], node.shape).ravel()
            la, lb, rows = (np.bincount(by, x.ravel(), trees * width * n).reshape(trees, width, n).cumsum(2)
                            for x in (weighted[:, 0], weighted[:, 1], drawn.sum(1)))
            some = (rows[..., :-1] > 0) & (rows[..., :-1] < rows[..., -1:])
            la, lb, whole = la[..., :-1], lb[..., :-1], np.maximum(weight, np.finfo(float).tiny)[..., None]
            ra, rb = a[..., None] - la, b[..., None] - lb
            gain = impurity[..., None] - (la + lb) / whole * _gini(la, lb) - (ra + rb) / whole * _gini(ra, rb)
            gain = np.where(some, gain, -np.inf)
            most, where = gain.max(2), gain.argmax(2)
            if allowed is not None:
                most = np.where(allowed[..., f], most, -np.inf)
            better = most > best
            best, feature, split = (np.where(better, x, y) for x, y in ((most, best), (f, feature), (where, split)))
        inner.append(live & (best > 0))
        right = bins[feature[first, node], np.arange(size)] > split[first, node]
        node = 2 * node + right
        at.append(node)
        live = np.repeat(inner[-1], 2, axis=1)
    # leaves side by side that predict the same class become one
    leaf = np.ones((trees, 1 << depth), bool)
    for level in range(depth - 1, -1, -1):
        says = stats[level + 1][1] > stats[level + 1][0]
        inner[level] &= ~(leaf[:, ::2] & leaf[:, 1::2] & (says[:, ::2] == says[:, 1::2]))
        leaf = ~inner[level]
    share, open_ = np.zeros((trees, size)), np.ones((trees, size), bool)
    for level in range(depth + 1):
        a, b = stats[level][:, first, at[level]]
        ends = open_ & ~inner[level][first, at[level]] if level < depth else open_
        share = np.where(ends, np.where(a + b > 0, b / np.maximum(a + b, np.finfo(float).tiny), 0.0), share)
        open_ = open_ & ~ends
    return share


def auc(score: np.ndarray, held: np.ndarray) -> float:
    """Area under the ROC curve of cells with rows (class, cell), as Spark's
    evaluator draws it."""
    _, at = np.unique(-score, return_inverse=True)
    rates = []
    for rows in held:
        n = np.cumsum(np.bincount(at, rows))
        rates.append(np.concatenate([[0.0], n / n[-1] if n[-1] else 0.0 * n, [1.0]]))
    x, y = rates
    return float(((x[1:] - x[:-1]) * (y[1:] + y[:-1]) / 2).sum())
