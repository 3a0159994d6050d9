"""Table-level rules: completeness, referential integrity, version order,
schema validation, hard/soft rule sets and user rule functions (SURVEY
2.E, E19-E26)."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabvet.operators import sequence as S
from tabvet.operators.rules import RuleSet


def _c(name: str) -> Column:
    return F.col(f"`{name}`")


# E19 -------------------------------------------------------------------------

def completeness(df: DataFrame, identifiers: list[str]) -> DataFrame:
    """Not-null rule over identifier columns: (column, present, nulls,
    valid).  An absent identifier is reported as not present / invalid."""
    present = [c for c in identifiers if c in df.columns]
    aggs = [F.count_if(_c(c).isNull()).alias(f"n{i}") for i, c in enumerate(present)]
    wide = df.agg(*aggs, F.count(F.lit(1)).alias("_rows"))
    structs = []
    for c in identifiers:
        if c in present:
            i = present.index(c)
            structs.append(F.struct(F.lit(c).alias("column"), F.lit(True).alias("present"),
                                    F.col(f"n{i}").alias("nulls"), (F.col(f"n{i}") == 0).alias("valid")))
        else:
            structs.append(F.struct(F.lit(c).alias("column"), F.lit(False).alias("present"),
                                    F.lit(None).cast("long").alias("nulls"), F.lit(False).alias("valid")))
    return wide.select(F.inline(F.array(*structs)))


# E20 -------------------------------------------------------------------------

def referential_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key has no parent (left anti join: both sides
    shuffle on the key; AQE splits a skewed key, or broadcasts a small
    parent side by its measured size)."""
    p = parent.select(_c(parent_key).alias("_pk")).distinct()
    return child.join(p, child[child_key] == p["_pk"], "left_anti")


# E21 -------------------------------------------------------------------------

def version_monotonic(df: DataFrame, entity: list[str], order: list[str], version: str,
                      rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """``record_version >= previous_record_version`` per entity in
    ``order``; the first record of an entity is valid."""
    d = S.with_lag(df, entity, order, version, "previous_version", rows_per_chunk=rows_per_chunk)
    valid = F.when(F.col("previous_version").isNull(), F.lit(True)).otherwise(
        F.coalesce(_c(version) >= F.col("previous_version"), F.lit(False)))
    return d.withColumn("VALID_version_control", valid).drop("_r")


# E23 / E26 -------------------------------------------------------------------

@dataclass
class _Rule:
    name: str
    fn: Callable
    variables: list
    kind: str
    weight: float


@dataclass
class HardSoftRules:
    """Hard rules (must hold) and weighted soft rules (scores in [0, 1]).

    A rule is a function ``DataFrame -> Column`` (or a rule text, compiled
    with the rule language, or a ``pandas_udf`` applied to columns).  A
    rule whose variables are absent from the table is skipped.  Per row:
    ``violations`` = names of hard rules not true (NULL counts as not
    true), ``soft_score`` = Σ w·s / Σ w over applicable soft rules, 1.0
    when there are none.
    """

    rules: list = field(default_factory=list)

    def add_rule(self, name: str, fn, variables: list[str], rule_type: str = "hard",
                 weight: float = 1.0) -> "HardSoftRules":
        self.rules.append(_Rule(name, fn, list(variables), rule_type, float(weight)))
        return self

    def _column(self, df: DataFrame, r: _Rule) -> Column:
        if isinstance(r.fn, str):
            return RuleSet([(r.name, r.fn)]).verdicts(df)[r.name]
        if isinstance(r.fn, Column):
            return r.fn
        return r.fn(df)

    def check(self, df: DataFrame) -> DataFrame:
        cols = set(df.columns)
        hard = [r for r in self.rules if r.kind == "hard" and all(v in cols for v in r.variables)]
        soft = [r for r in self.rules if r.kind != "hard" and all(v in cols for v in r.variables)]
        flags = [F.when(~F.coalesce(self._column(df, r).cast("boolean"), F.lit(False)), F.lit(r.name))
                 for r in hard]
        violations = F.array_compact(F.array(*flags)) if flags else F.array().cast("array<string>")
        if soft:
            num = sum(F.lit(r.weight) * self._column(df, r).cast("double") for r in soft)
            score = num / F.lit(sum(r.weight for r in soft))
        else:
            score = F.lit(1.0)
        return df.withColumn("violations", violations).withColumn("soft_score", score)


# E24 / E25 -------------------------------------------------------------------

@dataclass
class ColumnSchema:
    name: str
    feature_type: str  # continuous | categorical | other
    nullable: bool = False
    min_value: float | None = None
    max_value: float | None = None
    categories: list | None = None


def schema_checks(df: DataFrame, schemas: list[ColumnSchema]) -> dict[str, Column]:
    """Per-column validity: NULL allowed only if nullable; continuous must
    be numeric and inside [min, max]; categorical inside its list."""
    out = {}
    for s in schemas:
        if s.name not in df.columns:
            continue
        c = _c(s.name)
        dt = df.schema[s.name].dataType
        if s.feature_type == "continuous":
            if not isinstance(dt, T.NumericType):
                ok = F.lit(False)
            else:
                ok = F.lit(True)
                if s.min_value is not None:
                    ok = ok & (c >= F.lit(s.min_value))
                if s.max_value is not None:
                    ok = ok & (c <= F.lit(s.max_value))
        elif s.feature_type == "categorical" and s.categories:
            ok = c.cast("string").isin([str(v) for v in s.categories])
        else:
            ok = F.lit(True)
        out[s.name] = F.when(c.isNull(), F.lit(s.nullable)).otherwise(ok)
    return out


def schema_errors(df: DataFrame, schemas: list[ColumnSchema], key: str) -> DataFrame:
    """Long error table (column, row_key, value) of all failed checks."""
    checks = schema_checks(df, schemas)
    structs = [F.when(~ok, F.struct(F.lit(name).alias("column"), _c(key).cast("string").alias("row_key"),
                                     _c(name).cast("string").alias("value")))
               for name, ok in checks.items()]
    return df.select(F.explode(F.array_compact(F.array(*structs))).alias("e")).select("e.*")


def unschematised_columns(df: DataFrame, schemas: list[ColumnSchema]) -> DataFrame:
    """Table columns without a schema (anti join of two name lists)."""
    spark = df.sparkSession
    cols = spark.createDataFrame([(c,) for c in df.columns], "column string")
    known = spark.createDataFrame([(s.name,) for s in schemas], "column string")
    return cols.join(F.broadcast(known), "column", "left_anti")
