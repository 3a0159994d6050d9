"""Standard-normal CDF and quantile as plain SQL expressions.

Spark has no ``erf``; both functions are written as closed-form SQL text
that Spark (``F.expr``) and DuckDB evaluate identically, so that oracle
queries can use the very same formula.

* ``phi_sql``: Hart's double-precision rational approximation (as given
  by G. West, "Better approximations to cumulative normal functions",
  2005), |error| < 1e-14.
* ``phi_inv_sql``: P. J. Acklam's rational approximation of the
  inverse, relative error < 1.15e-9.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hart (1968) coefficients for the normal tail probability.
_HART_NUM = [
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165,
    33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376,
]
_HART_DEN = [
    8.83883476483184e-02, 1.75566716318264, 16.064177579207,
    86.7807322029461, 296.564248779674, 637.333633378831,
    793.826512519948, 440.413735824752,
]

# Acklam's coefficients for the inverse normal CDF.
_ACK_A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
          1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
_ACK_B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
          6.680131188771972e+01, -1.328068155288572e+01]
_ACK_C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
          -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
_ACK_D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
          3.754408661907416e+00]
_ACK_PLOW = 0.02425


def _horner(coefs: list[float], x: str) -> str:
    expr = repr(float(coefs[0]))
    for c in coefs[1:]:
        expr = f"(({expr}) * {x} + {float(c)!r})"
    return expr


def _d(v: float) -> str:
    """Double literal valid in both dialects (no DECIMAL typing)."""
    return f"CAST({float(v)!r} AS DOUBLE)"


def phi_sql(x: str) -> str:
    """SQL text for Φ(x); ``x`` is an SQL expression of type DOUBLE."""
    a = f"abs({x})"
    tail_small = (f"exp(-{a}*{a}/2.0) * {_horner(_HART_NUM, a)} / "
                  f"{_horner(_HART_DEN, a)}")
    cf = f"({a} + 1.0 / ({a} + 2.0 / ({a} + 3.0 / ({a} + 4.0 / ({a} + 0.65)))))"
    tail_big = f"exp(-{a}*{a}/2.0) / {cf} / 2.506628274631"
    tail = (f"(CASE WHEN {a} > 37.0 THEN {_d(0.0)} WHEN {a} < 7.07106781186547 "
            f"THEN {tail_small} ELSE {tail_big} END)")
    return f"(CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 0 THEN 1.0 - {tail} ELSE {tail} END)"


def phi_inv_sql(p: str) -> str:
    """SQL text for Φ⁻¹(p), p in (0,1); 0 and 1 map to ∓/± 8.3 (finite)."""
    plow, phigh = _ACK_PLOW, 1 - _ACK_PLOW
    ql = f"sqrt(-2.0 * ln({p}))"
    qh = f"sqrt(-2.0 * ln(1.0 - {p}))"
    low = f"({_horner(_ACK_C, ql)}) / (({_horner(_ACK_D + [1.0], ql)}))"
    high = f"-({_horner(_ACK_C, qh)}) / (({_horner(_ACK_D + [1.0], qh)}))"
    q = f"({p} - 0.5)"
    r = f"({q} * {q})"
    mid = f"({_horner(_ACK_A, r)}) * {q} / ({_horner(_ACK_B + [1.0], r)})"
    return (f"(CASE WHEN {p} IS NULL THEN NULL WHEN {p} <= 0.0 THEN {_d(-8.3)} "
            f"WHEN {p} >= 1.0 THEN {_d(8.3)} "
            f"WHEN {p} < {plow!r} THEN {low} WHEN {p} > {phigh!r} THEN {high} "
            f"ELSE {mid} END)")


def _horner_col(coefs: list[float], x: Column) -> Column:
    acc = F.lit(float(coefs[0]))
    for c in coefs[1:]:
        acc = acc * x + F.lit(float(c))
    return acc


def phi(col: Column | str) -> Column:
    """Column Φ(col); same formula as ``phi_sql``."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    a = F.abs(x)
    e = F.exp(-a * a / 2.0)
    small = e * _horner_col(_HART_NUM, a) / _horner_col(_HART_DEN, a)
    cf = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
    big = e / cf / 2.506628274631
    tail = (F.when(a > 37.0, F.lit(0.0))
            .when(a < 7.07106781186547, small).otherwise(big))
    return F.when(x.isNull(), F.lit(None).cast("double")) \
        .when(x > 0, 1.0 - tail).otherwise(tail)


def phi_inv(col: Column | str) -> Column:
    """Column Φ⁻¹(col); same formula as ``phi_inv_sql``."""
    p = (F.col(col) if isinstance(col, str) else col).cast("double")
    ql = F.sqrt(-2.0 * F.log(p))
    qh = F.sqrt(-2.0 * F.log(1.0 - p))
    low = _horner_col(_ACK_C, ql) / _horner_col(_ACK_D + [1.0], ql)
    high = -_horner_col(_ACK_C, qh) / _horner_col(_ACK_D + [1.0], qh)
    q = p - 0.5
    r = q * q
    mid = _horner_col(_ACK_A, r) * q / _horner_col(_ACK_B + [1.0], r)
    return (F.when(p.isNull(), F.lit(None).cast("double"))
            .when(p <= 0.0, F.lit(-8.3)).when(p >= 1.0, F.lit(8.3))
            .when(p < _ACK_PLOW, low).when(p > 1 - _ACK_PLOW, high)
            .otherwise(mid))


SQRT_2PI = math.sqrt(2 * math.pi)
