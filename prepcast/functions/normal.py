"""Inverse standard normal CDF as a JVM-side column expression.

Acklam's rational approximation (relative error below 1.2e-9 over (0, 1)),
written once as SQL text so that Spark and the DuckDB oracle evaluate the same
formula. Used for Shapiro-Wilk weights, which thereby need no Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed published coefficients of the approximation.
A = [-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
     1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00]
B = [-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
     6.680131188771972e+01, -1.328068155288572e+01]
C = [-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
     -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00]
D = [7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
     3.754408661907416e+00]
P_LOW = 0.02425


def _lit(v: float) -> str:
    return f"CAST({v!r} AS DOUBLE)"


def _horner(coefs: list[float], x: str) -> str:
    out = _lit(coefs[0])
    for c in coefs[1:]:
        out = f"({out} * {x} + {_lit(c)})"
    return out


def norm_ppf_sql(p: str) -> str:
    """SQL text of the inverse normal CDF of the expression ``p``."""
    ql = f"sqrt(-2 * ln({p}))"
    qh = f"sqrt(-2 * ln(1 - {p}))"
    r = f"(({p} - 0.5) * ({p} - 0.5))"
    low = f"({_horner(C, ql)} / ({_horner(D, ql)} * {ql} + 1))"
    mid = f"({_horner(A, r)} * ({p} - 0.5) / ({_horner(B, r)} * {r} + 1))"
    high = f"(-{_horner(C, qh)} / ({_horner(D, qh)} * {qh} + 1))"
    return f"(CASE WHEN {p} < {_lit(P_LOW)} THEN {low} WHEN {p} <= {_lit(1 - P_LOW)} THEN {mid} ELSE {high} END)"


def norm_ppf(p: str) -> Column:
    """Inverse normal CDF of the numeric column named ``p``."""
    return F.expr(norm_ppf_sql(f"`{p}`"))


# Fixed published coefficients of Hart's double-precision normal tail algorithm.
HART_NUM = [3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
            112.079291497871, 221.213596169931, 220.206867912376]
HART_DEN = [8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
            296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
HART_SPLIT = 7.07106781186547
SQRT_2PI = 2.506628274631


def _tail_sql(a: str) -> str:
    """P(Z > a) for a >= 0."""
    e = f"exp(-({a}) * ({a}) / 2)"
    rational = f"({e} * {_horner(HART_NUM, a)} / {_horner(HART_DEN, a)})"
    cf = f"({a} + {_lit(1.0)} / ({a} + {_lit(2.0)} / ({a} + {_lit(3.0)} / ({a} + {_lit(4.0)} / ({a} + {_lit(0.65)})))))"
    far = f"({e} / {cf} / {_lit(SQRT_2PI)})"
    return f"(CASE WHEN {a} > 37 THEN 0.0 WHEN {a} < {_lit(HART_SPLIT)} THEN {rational} ELSE {far} END)"


def norm_sf_sql(z: str) -> str:
    """SQL text of the standard normal upper tail P(Z > z)."""
    t = _tail_sql(f"abs({z})")
    return f"(CASE WHEN {z} IS NULL THEN NULL WHEN {z} >= 0 THEN {t} ELSE 1.0 - {t} END)"


def norm_sf(z: str) -> Column:
    """Standard normal upper tail of the numeric column named ``z``."""
    return F.expr(norm_sf_sql(f"`{z}`"))
