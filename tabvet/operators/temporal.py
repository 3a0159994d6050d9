"""Temporal rules and calendar features.

Entity-level event rules are one grouped aggregation (first timestamp of
each event type per entity); per-row order rules use the chunked
sequence kernel, so a hot entity never lands in a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabvet.operators import sequence as S


def _seconds_between(a: Column, b: Column) -> Column:
    """b - a in seconds with microsecond precision (time-zone free)."""
    return F.timestamp_diff("MICROSECOND", a, b) / 1e6


def first_times(events: DataFrame, entity: str, type_col: str, ts_col: str, types: list[str]) -> DataFrame:
    """(entity, first_<type>...) = earliest timestamp of each event type."""
    aggs = [F.min(F.when(F.col(type_col) == t, F.col(ts_col))).alias(f"first_{t}") for t in types]
    return events.groupBy(entity).agg(*aggs)


def sequence_rule(events: DataFrame, entity: str, type_col: str, ts_col: str, a: str, b: str) -> DataFrame:
    """A strictly before B; an entity lacking either event is valid."""
    ft = first_times(events, entity, type_col, ts_col, [a, b])
    ta, tb = F.col(f"first_{a}"), F.col(f"first_{b}")
    return ft.withColumn("VALID_sequence", F.when(ta.isNull() | tb.isNull(), F.lit(True)).otherwise(ta < tb))


def duration_rule(events: DataFrame, entity: str, type_col: str, ts_col: str, a: str, b: str,
                  min_seconds: float = 0.0, max_seconds: float = float("inf")) -> DataFrame:
    """min <= seconds(B - A) <= max; absent events are valid."""
    ft = first_times(events, entity, type_col, ts_col, [a, b])
    ta, tb = F.col(f"first_{a}"), F.col(f"first_{b}")
    dur = _seconds_between(ta, tb)
    ok = (dur >= F.lit(min_seconds)) & (dur <= F.lit(max_seconds)) if max_seconds != float("inf") \
        else (dur >= F.lit(min_seconds))
    return ft.withColumn("duration_seconds", dur) \
        .withColumn("VALID_duration", F.when(ta.isNull() | tb.isNull(), F.lit(True)).otherwise(ok))


def _truthy(df: DataFrame, c: str) -> Column:
    dt = df.schema[c].dataType.simpleString()
    col = F.col(f"`{c}`")
    if dt == "boolean":
        return F.coalesce(col, F.lit(False))
    if dt == "string":
        return F.coalesce(col != "", F.lit(False))
    return F.coalesce(col.cast("double") != 0, F.lit(False))


class DependencyRules:
    """Dependent -> prerequisites; a row is valid when every
    prerequisite column exists and is truthy.  Registrations accumulate
    into a dependency edge table."""

    def __init__(self):
        self.graph: dict[str, list[str]] = {}

    def add(self, dependent: str, prerequisites: list[str]) -> "DependencyRules":
        self.graph.setdefault(dependent, []).extend(prerequisites)
        return self

    def edges(self, spark) -> DataFrame:
        rows = [(d, p) for d, ps in self.graph.items() for p in ps]
        return spark.createDataFrame(rows, "dependent string, prerequisite string")

    def verdicts(self, df: DataFrame) -> dict[str, Column]:
        out = {}
        for dep, pres in self.graph.items():
            ok = F.lit(True)
            for p in pres:
                ok = ok & (_truthy(df, p) if p in df.columns else F.lit(False))
            out[f"DEP_{dep}"] = ok
        return out

    def validate(self, df: DataFrame) -> DataFrame:
        return df.select("*", *[c.alias(n) for n, c in self.verdicts(df).items()])


def order_check(df: DataFrame, order: list[str], value: str, entity: list[str] | None = None,
                rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """a row is invalid when its value is below the previous row's (in
    ``order``, optionally per entity); the first row and NULLs are valid."""
    ent = entity or []
    if not ent:
        df = df.withColumn("_one", F.lit(0))
        ent = ["_one"]
    d = S.with_lag(df, ent, order, value, "_prev", rows_per_chunk=rows_per_chunk)
    valid = F.coalesce(~(F.col(value) < F.col("_prev")), F.lit(True))
    return d.withColumn("VALID_SEQUENCE", valid).drop("_prev", "_r", "_one")


def calendar_features(df: DataFrame, ts_col: str) -> DataFrame:
    """YEAR, MONTH, DAY, HOUR, DAY_OF_WEEK (Mon = 0), IS_WEEKEND,
    QUARTER, WEEK_OF_YEAR (ISO)."""
    t = F.col(ts_col)
    if df.schema[ts_col].dataType.simpleString() == "string":
        t = F.try_to_timestamp(t)
    dow = F.weekday(t)
    return df.select("*", F.year(t).alias("YEAR"), F.month(t).alias("MONTH"), F.dayofmonth(t).alias("DAY"),
                     F.hour(t).alias("HOUR"), dow.alias("DAY_OF_WEEK"), dow.isin(5, 6).cast("int").alias("IS_WEEKEND"),
                     F.quarter(t).alias("QUARTER"), F.weekofyear(t).alias("WEEK_OF_YEAR"))


def interval_rule(df: DataFrame, entity: list[str], order: list[str], ts_col: str,
                  min_seconds: float, max_seconds: float, rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """F7 INTERVAL: the gap to the entity's previous event lies in
    [min, max] seconds; the first event is valid."""
    d = S.with_lag(df, entity, order, ts_col, "_prev_ts", rows_per_chunk=rows_per_chunk)
    gap = _seconds_between(F.col("_prev_ts"), F.col(ts_col))
    return d.withColumn("gap_seconds", gap).withColumn(
        "VALID_interval", F.when(F.col("_prev_ts").isNull(), F.lit(True))
        .otherwise((gap >= min_seconds) & (gap <= max_seconds))).drop("_prev_ts", "_r")


def periodic_rule(df: DataFrame, entity: list[str], order: list[str], ts_col: str, period_seconds: float,
                  tolerance_seconds: float, rows_per_chunk: int = S.ROWS_PER_CHUNK) -> DataFrame:
    """F7 PERIODIC: the gap to the previous event is within ``tolerance``
    of a whole number of periods."""
    d = S.with_lag(df, entity, order, ts_col, "_prev_ts", rows_per_chunk=rows_per_chunk)
    gap = _seconds_between(F.col("_prev_ts"), F.col(ts_col))
    r = F.pmod(gap, F.lit(float(period_seconds)))
    ok = (r <= tolerance_seconds) | (F.lit(float(period_seconds)) - r <= tolerance_seconds)
    return d.withColumn("VALID_periodic", F.when(F.col("_prev_ts").isNull(), F.lit(True)).otherwise(ok)) \
        .drop("_prev_ts", "_r")


def deadline_rule(df: DataFrame, ts_col: str, deadline) -> Column:
    """F7 DEADLINE: timestamp on or before the deadline (NULL -> False)."""
    return F.coalesce(F.col(ts_col) <= F.lit(deadline).cast("timestamp_ntz"), F.lit(False))
