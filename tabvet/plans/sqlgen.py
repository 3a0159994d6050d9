"""Helpers that write DuckDB oracle text (kept apart from the Spark plans)."""

from __future__ import annotations


def long_sql(table: str, cols: list[str], kind: str = "double", keep: list[str] | None = None) -> str:
    keep = keep or []
    k = "".join(f"{c}, " for c in keep)
    cast = "DOUBLE" if kind == "double" else "VARCHAR"
    return " UNION ALL ".join(
        f"SELECT {k}'{c}' AS feature, CAST({c} AS {cast}) AS v FROM {table}" for c in cols)


def counts_sql(table: str, cols: list[str]) -> str:
    return (f"SELECT feature, v, CAST(count(*) AS BIGINT) AS cnt FROM ({long_sql(table, cols, 'string')}) "
            f"WHERE v IS NOT NULL GROUP BY feature, v")


def kolmogorov_sql(x: str, terms: int = 100) -> str:
    return (f"(CASE WHEN {x} <= 0 THEN 1.0 ELSE least(greatest(2.0 * (SELECT sum(power(-1.0, k - 1) * "
            f"exp(-2.0 * k * k * ({x}) * ({x}))) FROM range(1, {terms + 1}) t(k)), 0.0), 1.0) END)")
