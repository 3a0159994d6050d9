"""Three-valued verdict columns.

A rule verdict is a nullable boolean Column: true = valid, false =
violated, NULL = not applicable.  The combinators below implement the
rule language's logic, which is *not* SQL's Kleene logic: any
not-applicable operand makes the whole result not applicable, and
operators chain strictly left to right.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F



def na() -> Column:
    return F.lit(None).cast("boolean")


def definite(c: Column) -> Column:
    """Null value -> False (atoms: a missing value is a violation)."""
    return F.coalesce(c, F.lit(False))


def t3_and(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), na()).otherwise(a & b)


def t3_or(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), na()).otherwise(a | b)


def t3_xor(a: Column, b: Column) -> Column:
    return F.when(a.isNull() | b.isNull(), na()).otherwise(a != b)


def t3_not_right(a: Column, b: Column) -> Column:
    """Infix ``A NOT B`` evaluates to ``NOT B`` (A only gates N/A)."""
    return F.when(a.isNull() | b.isNull(), na()).otherwise(~b)


def t3_if(cond: Column, then: Column) -> Column:
    """IF c THEN t: c N/A -> N/A, c true -> t, c false -> true."""
    return F.when(cond.isNull(), na()).when(cond, then).otherwise(F.lit(True))


_OPS = {"AND": t3_and, "OR": t3_or, "XOR": t3_xor, "NOT": t3_not_right}


def t3_chain(operands: list[Column], ops: list[str]) -> Column:
    """Left-to-right fold: ``ops[i-1]`` joins the running value with
    ``operands[i]``; surplus operators are ignored."""
    if not operands:
        return F.lit(True)
    res = operands[0]
    for i, op in enumerate(ops, start=1):
        if i >= len(operands):
            break
        res = _OPS[op.upper()](res, operands[i])
    return res


def mask(verdicts: list[Column]) -> Column:
    """Row mask: AND of verdicts with N/A counted as satisfied."""
    if not verdicts:
        return F.lit(True)
    return reduce(lambda x, y: x & y, [F.coalesce(v, F.lit(True)) for v in verdicts])
