"""Synthetic tables that keep the dependence between columns (K5).

Columns are drawn one after the other along a dependency graph (C13), each
given its strongest parents: ancestral sampling from the conditional
frequencies of the real table (H2).  Every column is a code: texts and flags as
they are, numbers and dates by the quantile bin they lie in, NULL by a code of
its own, so all columns can be parents.  A drawn configuration of parents that
no real row has falls back to its strongest parents alone, at last to the
column's own frequencies.  A number is placed inside its bin by a second hash
uniform, so shapes with several modes survive without a mixture model; dates
are seconds between the bin's edges, integers are rounded.

A column costs one aggregation of the coded table and joins of the drawn rows
with the configurations seen and the stretches of their counts; sides are
broadcast by size, and beyond that rows of a frequent configuration spread over
ranges of its counts.

Defined results: an empty real table gives rows of NULLs; columns without edges
are drawn on their own; edges to other columns are ignored; a graph with a
cycle raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.functions.hashing import hu
from tabvet.operators.generate import categorical_table, draw_categorical
from tabvet.operators.profile import quantiles, to_long
from tabvet.session import cut_lineage, sized

NULL_CODE = "null"
BINS, MAX_PARENTS = 32, 2
#: Columns drawn before the lineage is cut.
CUT_EVERY = 4


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


def parents_of(columns: list[str], edges: list[tuple[str, str, float]], most: int) -> dict[str, list[str]]:
    """Up to ``most`` strongest parents of each column (ties by name)."""
    found = {c: [(-s, a) for a, b, s in edges if b == c and a in columns and a != c] for c in columns}
    return {c: [a for _, a in sorted(set(p))[:most]] for c, p in found.items()}


def drawing_order(parents: dict[str, list[str]]) -> list[str]:
    """Parents before children, otherwise in the given order."""
    out: list[str] = []
    while len(out) < len(parents):
        ready = [c for c in parents if c not in out and all(p in out for p in parents[c])]
        if not ready:
            raise ValueError(f"the graph has a cycle among {sorted(set(parents) - set(out))}")
        out += ready
    return out


class Codes:
    """Codes of every column and their way back."""

    def __init__(self, real: DataFrame, categorical: list[str], numeric: list[str], dates: list[str], bins: int):
        self.categorical, self.numeric, self.dates = list(categorical), list(numeric), list(dates)
        self.columns = [*categorical, *numeric, *dates]
        self.types = {c: real.schema[c].dataType for c in self.columns}
        binned = [*numeric, *dates]
        self.edges: dict[str, list[float]] = {c: [] for c in binned}
        if binned:
            values = real.select(*[self._number(c).alias(c) for c in binned])
            found = quantiles(to_long(values, binned), ["feature"], "v", [i / bins for i in range(bins + 1)])
            for r in found.collect():                      # bins + 1 rows a column
                self.edges[r["feature"]].append(r["q"])
            self.edges = {c: sorted(set(e)) for c, e in self.edges.items()}

    def _number(self, c: str) -> Column:
        if c in self.dates:
            return F.unix_micros(_c(c).cast("timestamp")) / 1e6
        return _c(c).cast("double")

    def encode(self, real: DataFrame) -> DataFrame:
        out = []
        for c in self.columns:
            code = _c(c).cast("string")
            if c not in self.categorical:
                x = self._number(c)
                inner = F.array(*[F.lit(float(e)) for e in self.edges[c][1:-1]]).cast("array<double>")
                code = F.when(x.isNotNull() & ~F.isnan(x), F.size(F.filter(inner, lambda e: e < x)).cast("string"))
            # texts get a mark, so that no text is taken for the NULL code
            text = F.concat(F.lit("="), code) if c in self.categorical else code
            out.append(F.coalesce(text, F.lit(NULL_CODE)).alias(c))
        return real.select(*out)

    def decode(self, drawn: DataFrame, seed: int | str) -> DataFrame:
        out = [F.col("row_id")]
        for c in self.columns:
            known = F.when(_c(c) != NULL_CODE, _c(c))
            if c in self.categorical:
                out.append(F.substring(known, 2, 1 << 30).cast(self.types[c]).alias(c))
                continue
            edges = F.array(*[F.lit(float(e)) for e in self.edges[c]]).cast("array<double>")
            i = known.cast("int")
            low = F.get(edges, i)
            x = low + hu(f"{seed}:{c}:v", "row_id") * (F.coalesce(F.get(edges, i + 1), low) - low)
            if c in self.dates:
                x = F.timestamp_seconds(F.round(x).cast("long"))
            elif isinstance(self.types[c], T.IntegralType):
                x = F.round(x)
            out.append(x.cast(self.types[c]).alias(c))
        return drawn.select(*out)


def _config(parents: list[str], level: int) -> Column:
    """Name of the configuration of the first ``level`` parents."""
    parts = [F.concat(F.length(_c(p)).cast("string"), F.lit(":"), _c(p)) for p in parents[:level]]
    return F.concat(F.lit(f"{level};"), *parts)


def draw_child(drawn: DataFrame, coded: DataFrame, child: str, parents: list[str], seed: int | str) -> DataFrame:
    """``drawn`` with a code of ``child`` given the row's parents, falling back
    to fewer parents where no real row has their configuration."""
    counts = coded.groupBy(*[_c(p) for p in parents], _c(child).alias("_code")).agg(F.count(F.lit(1)).alias("_n"))
    levels = [counts.select(_config(parents, k).alias("_cfg"), "_code", "_n") for k in range(len(parents) + 1)]
    every = levels[0]
    for level in levels[1:]:
        every = every.unionByName(level)
    every = cut_lineage(every.groupBy("_cfg", "_code").agg(F.sum("_n").alias("_n")))
    table = cut_lineage(categorical_table(every, "_code", ["_cfg"], weight="_n"))
    seen = table.select("_cfg").distinct()
    chosen = F.lit("0;")
    rows = drawn
    for k in range(1, len(parents) + 1):
        side = sized(seen.filter(F.col("_cfg").startswith(f"{k};")).select(F.col("_cfg").alias(f"_seen{k}")))
        rows = rows.join(side, _config(parents, k) == F.col(f"_seen{k}"), "left")
        chosen = F.coalesce(F.col(f"_seen{k}"), chosen)
    rows = rows.select(*[_c(c) for c in drawn.columns], chosen.alias("_cfg"))
    return draw_categorical(rows, table, ["_cfg"], child, "row_id", f"{seed}:{child}").drop("_cfg")


def dependent_synthesis(spark: SparkSession, real: DataFrame, n: int, edges: list[tuple[str, str, float]],
                        categorical: list[str], numeric: list[str] = (), dates: list[str] = (), bins: int = BINS,
                        max_parents: int = MAX_PARENTS, seed: int | str = 7) -> DataFrame:
    """``n`` rows (row_id and the columns in their own types); ``edges`` are
    (parent, child, strength), as ``relations.dependency_dag`` gives them."""
    codes = Codes(real, categorical, list(numeric), list(dates), bins)
    parents = parents_of(codes.columns, edges, max_parents)
    coded = cut_lineage(codes.encode(real))
    drawn = spark.range(n).withColumnRenamed("id", "row_id")
    for k, c in enumerate(drawing_order(parents), 1):
        drawn = draw_child(drawn, coded, c, parents[c], seed)
        if k % CUT_EVERY == 0:
            drawn = cut_lineage(drawn)
    return codes.decode(drawn, seed)
