"""Exact nearest neighbours over adaptive cells.

Base points are cut into cells by median splits (a k-d tree over a bounded
sample of the distinct points), so dense regions have small cells and one far
outlier does not stretch them.  Equal points are one candidate with a
multiplicity, and equal queries are searched once.  A query first meets the
points of its own cell; the k-th distance found there bounds its search, and
only cells whose box that ball reaches are visited in a second round.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.session import cut_lineage

#: Base points per cell, and the sample that the splits come from (8 bytes a coordinate on the driver).
CELL_POINTS = 1000
MAX_SAMPLE = 1_000_000
#: Query points that one task holds beside a cell.
QUERY_PAGE = 4000


@dataclass
class Cells:
    """Median splits: node -> (axis, value, left, right); leaves have axis -1
    and their number in ``left``.  low / high: the leaves' boxes."""
    axis: np.ndarray
    value: np.ndarray
    left: np.ndarray
    right: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @classmethod
    def split(cls, sample: np.ndarray, leaf_rows: float) -> "Cells":
        d = sample.shape[1]
        nodes, low, high = [], [], []
        todo = [(np.arange(len(sample)), np.full(d, -np.inf), np.full(d, np.inf), None)]
        while todo:
            rows, lo, hi, parent = todo.pop()
            me = len(nodes)
            if parent is not None:
                nodes[parent[0]][parent[1]] = me
            x = sample[rows]
            spread = x.max(0) - x.min(0) if len(rows) else np.zeros(d)
            axis = int(spread.argmax())
            cut = float(np.median(x[:, axis])) if len(rows) else 0.0
            below = x[:, axis] < cut
            if len(rows) <= leaf_rows or not below.any():
                nodes.append([-1, 0.0, len(low), -1])
                low.append(lo)
                high.append(hi)
                continue
            nodes.append([axis, cut, -1, -1])
            for part, side in ((below, 2), (~below, 3)):
                lo2, hi2 = lo.copy(), hi.copy()
                (hi2 if side == 2 else lo2)[axis] = cut
                todo.append((rows[part], lo2, hi2, (me, side)))
        a, v, left, right = zip(*nodes)
        return cls(np.array(a), np.array(v), np.array(left), np.array(right), np.array(low), np.array(high))

    def of(self, x: np.ndarray) -> np.ndarray:
        """Cell number of each point."""
        node = np.zeros(len(x), np.int64)
        while True:
            axis = self.axis[node]
            inner = np.flatnonzero(axis >= 0)
            if not len(inner):
                return self.left[node]
            at = node[inner]
            below = x[inner, axis[inner]] < self.value[at]
            node[inner] = np.where(below, self.left[at], self.right[at])

    def reached(self, x: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(point, cell) for all cells that each point's ball reaches."""
        points, cells = [], []
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            axis = self.axis[node]
            if axis < 0:
                leaf = self.left[node]
                gap = np.maximum(np.maximum(self.low[leaf] - x[rows], x[rows] - self.high[leaf]), 0.0)
                rows = rows[np.sqrt((gap * gap).sum(1)) <= radius[rows]]
                points.append(rows)
                cells.append(np.full(len(rows), leaf))
                continue
            off = x[rows, axis] - self.value[node]
            for child, touches in ((self.left[node], off <= radius[rows]), (self.right[node], off >= -radius[rows])):
                if touches.any():
                    todo.append((child, rows[touches]))
        return (np.concatenate(points), np.concatenate(cells)) if points else (np.zeros(0, int), np.zeros(0, int))


def _nearest(queries: pd.DataFrame, base: pd.DataFrame, cols: list[str], k: int, names: list[str]) -> pd.DataFrame:
    """Per query the base points of one cell up to its radius, nearest first,
    until they hold ``k`` rows."""
    if queries.empty or base.empty:
        return pd.DataFrame(columns=names)
    b, n = base[cols].to_numpy(float), base["_n"].to_numpy()
    out = []
    for start in range(0, len(queries), max(1, 4_000_000 // len(base))):
        part = queries.iloc[start:start + max(1, 4_000_000 // len(base))]
        q = part[cols].to_numpy(float)
        d2 = np.zeros((len(q), len(b)))
        for j in range(len(cols)):
            d2 += (q[:, j:j + 1] - b[None, :, j]) ** 2
        dist = np.sqrt(d2)
        # a point has one row at least, so the k-th nearest point bounds what is sorted
        bound = np.partition(dist, k - 1, axis=1)[:, k - 1] if len(b) > k else np.full(len(q), np.inf)
        row, col = np.nonzero(dist <= np.where(np.isnan(bound), np.inf, bound)[:, None])
        near = dist[row, col]
        order = np.lexsort((col, near, row))
        row, col, near = row[order], col[order], near[order]
        rows = n[col]
        upto = np.cumsum(rows) - rows
        before = upto - upto[np.searchsorted(row, row)]
        # all points at the distance that completes k rows stay: ties are settled by key later
        last = np.full(len(q), -1.0)
        np.maximum.at(last, row[before < k], near[before < k])
        take = near <= np.minimum(last, part["_r"].to_numpy())[row]
        row, picked, near = row[take], col[take], near[take]
        frame = part[cols].iloc[row].reset_index(drop=True)
        frame["_d"], frame["_n"] = near, n[picked]
        if "_keys" in names:
            frame["_keys"] = base["_keys"].to_numpy()[picked]
        out.append(frame[names])
    return pd.concat(out)


def candidates(query: DataFrame, base: DataFrame, cols: list[str], k: int) -> DataFrame:
    """(cols..., _d, _n[, _keys]): for each distinct query point the nearest
    base points that hold ``k`` rows together, or all if there are fewer.
    ``base``: distinct points with ``_n`` rows each and perhaps ``_keys``."""
    spark = query.sparkSession
    base = cut_lineage(base.select(*[F.col(c).cast("double").alias(c) for c in cols],
                                   *[c for c in base.columns if c in ("_n", "_keys")]))
    points = cut_lineage(query.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().distinct())
    total = base.count()
    keyed = [f for f in base.schema if f.name == "_keys"]
    result = T.StructType([*[T.StructField(c, T.DoubleType()) for c in cols], T.StructField("_d", T.DoubleType()),
                           T.StructField("_n", T.LongType()), *keyed])
    if not total:
        return spark.createDataFrame([], result)
    want = min(MAX_SAMPLE, max(2000, total // 50))
    sample = np.array([list(r) for r in base.select(*cols).orderBy(F.xxhash64(*cols), *cols).limit(want).collect()], float)
    cells = Cells.split(sample, max(8.0, max(CELL_POINTS, 4 * k) * len(sample) / total))
    sent = spark.sparkContext.broadcast(cells)

    def placed(df: DataFrame) -> DataFrame:
        schema = T.StructType([*df.schema, T.StructField("_cell", T.LongType())])
        return df.mapInPandas(lambda it: (p.assign(_cell=sent.value.of(p[cols].to_numpy(float))) for p in it), schema)

    def searched(q: DataFrame) -> DataFrame:
        """q: cols, _r, _cell.  A cell with many queries is copied once a page."""
        size = q.groupBy("_cell").agg(F.ceil(F.count(F.lit(1)) / QUERY_PAGE).cast("int").alias("_pages"))
        size = cut_lineage(size)
        left = q.join(size, "_cell").withColumn("_page", F.pmod(F.xxhash64(*cols), F.col("_pages")).cast("int"))
        right = home.join(size, "_cell").withColumn("_page", F.explode(F.sequence(F.lit(0), F.col("_pages") - 1)))
        names = result.names
        return (left.drop("_pages").groupBy("_cell", "_page").cogroup(right.drop("_pages").groupBy("_cell", "_page"))
                .applyInPandas(lambda a, b: _nearest(a, b, cols, k, names), result))

    home = cut_lineage(placed(base))
    own = cut_lineage(placed(points.withColumn("_r", F.lit(float("inf")))))
    first = cut_lineage(searched(own))
    # the k-th distance in the own cell (infinite where the cell holds fewer rows)
    by = Window.partitionBy(*cols).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    found = (first.withColumn("_upto", F.sum("_n").over(by)).groupBy(*cols)
             .agg(F.min(F.when(F.col("_upto") >= k, F.col("_d"))).alias("_r")))
    bounded = own.drop("_r").join(found, cols, "left").select(
        *cols, F.coalesce("_r", F.lit(float("inf"))).alias("_r"), F.col("_cell").alias("_own"))

    def others(it):
        for p in it:
            point, cell = sent.value.reached(p[cols].to_numpy(float), p["_r"].to_numpy())
            out = p.iloc[point][[*cols, "_r"]].reset_index(drop=True)
            out["_cell"] = cell
            yield out[cell != p["_own"].to_numpy()[point]]

    far = bounded.mapInPandas(others, T.StructType([*own.schema]))
    return first.unionByName(searched(cut_lineage(far)))


def kth(query: DataFrame, base: DataFrame, cols: list[str], qkey: str, k: int, own: bool) -> DataFrame:
    """(qkey, kth_distance, mean_distance) over the k nearest base rows of each
    query row, or over all if there are fewer.  With ``own`` the query rows are
    base rows themselves and don't count for themselves."""
    points = base.select(*[F.col(c).cast("double").alias(c) for c in cols]).dropna().groupBy(*cols).agg(
        F.count(F.lit(1)).alias("_n"))
    near = candidates(query, points, cols, k + int(own))
    if own:
        near = near.withColumn("_n", F.col("_n") - (F.col("_d") == 0).cast("long")).filter("_n > 0")
    by = Window.partitionBy(*cols).orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_before", F.sum("_n").over(by) - F.col("_n")).filter(F.col("_before") < k)
    take = F.least(F.col("_n"), F.lit(k) - F.col("_before"))
    per = near.groupBy(*cols).agg(F.max("_d").alias("kth_distance"),
                                  (F.sum(F.col("_d") * take) / F.sum(take)).alias("mean_distance"))
    rows = query.select(F.col(qkey), *[F.col(c).cast("double").alias(c) for c in cols])
    return rows.join(cut_lineage(per), cols).select(qkey, "kth_distance", "mean_distance")


def pairs(df: DataFrame, cols: list[str], key: str, k: int, salts: int = 64) -> DataFrame:
    """(key, neighbor, distance, rank): the k nearest other rows of each row,
    ties by key."""
    rows = df.select(F.col(key).alias("_key"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    # the k + 1 smallest keys of each point, found in two steps for points that many rows share
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_key"), F.lit(salts)))
    few = salted.withColumn("_i", F.row_number().over(Window.partitionBy(*cols, "_salt").orderBy("_key"))).filter(
        F.col("_i") <= k + 1)
    few = few.withColumn("_i", F.row_number().over(Window.partitionBy(*cols).orderBy("_key"))).filter(F.col("_i") <= k + 1)
    points = few.groupBy(*cols).agg(F.array_sort(F.collect_list("_key")).alias("_keys"), F.count(F.lit(1)).alias("_n"))
    near = candidates(rows, points, cols, k + 1).select(*cols, "_d", F.explode("_keys").alias("_near"))
    by = Window.partitionBy(*cols).orderBy("_d", "_near")
    near = cut_lineage(near.withColumn("_i", F.row_number().over(by)).filter(F.col("_i") <= k + 1))
    lists = near.groupBy(*cols).agg(F.array_sort(F.collect_list(F.struct("_i", "_d", "_near"))).alias("_list"))
    others = F.filter("_list", lambda x: x["_near"] != F.col("_key"))
    return (rows.join(lists, cols).select("_key", F.posexplode(F.slice(others, 1, k)).alias("_p", "_x"))
            .select(F.col("_key").alias(key), F.col("_x._near").alias("neighbor"), F.col("_x._d").alias("distance"),
                    (F.col("_p") + 1).alias("rank")))
