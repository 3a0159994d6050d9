"""Query registry: each entry is a Spark plan over the driver's tables
plus (optionally) the equivalent DuckDB SQL used as a correctness oracle.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Query:
    name: str
    fn: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    tables: tuple = ()


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = Query(name, fn, sql)
        return fn
    return deco


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), digits)


def load_all() -> dict[str, Query]:
    # import for registration side effects
    import tabvet.plans.q_rules  # noqa: F401
    import tabvet.plans.flagship  # noqa: F401
    for mod in ("q_rules2", "q_profile", "q_typing", "q_encode", "q_pipeline", "q_fidelity", "q_temporal",
                "q_heal", "q_privacy", "q_generate", "q_metriclog", "q_sources", "q_streaming"):
        try:
            __import__(f"tabvet.plans.{mod}")
        except ModuleNotFoundError as exc:
            if exc.name != f"tabvet.plans.{mod}":
                raise
    return QUERIES
