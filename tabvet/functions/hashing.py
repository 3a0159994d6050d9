"""Deterministic hash uniforms (HU).

Every random draw in the library is a pure function of a seed and a row
key, so results are reproducible across re-executions (executor loss,
AQE re-planning) and checkable from SQL: the first 13 hex digits of an
md5 digest are a 52-bit integer, divided by 2**52.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO52 = float(2 ** 52)


def hu(seed: int | str, *keys: Column | str) -> Column:
    """Uniform double in [0, 1) from md5(seed | key1 | key2 ...).

    Keys should be integers or strings: their text form is hashed.
    """
    parts = [F.lit(str(seed))] + [
        (F.col(k) if isinstance(k, str) else k).cast("string") for k in keys]
    h = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(h, 16, 10).cast("double") / F.lit(TWO52)


def hu_sql(seed: int | str, *keys: str) -> str:
    """DuckDB text of ``hu`` (keys are SQL expressions)."""
    inner = ", ".join([f"'{seed}'"] + [f"CAST({k} AS VARCHAR)" for k in keys])
    return (f"(CAST(('0x' || substr(md5(concat_ws('|', {inner})), 1, 13)) AS BIGINT)"
            f" / {TWO52!r})")


def normal_draw(seed: int | str, *keys: Column | str) -> Column:
    """Standard normal via Box-Muller over two independent HU streams."""
    u1 = F.greatest(hu(f"{seed}a", *keys), F.lit(1e-300))
    u2 = hu(f"{seed}b", *keys)
    return F.sqrt(-2.0 * F.log(u1)) * F.cos(2 * 3.141592653589793 * u2)
