"""Tail probabilities and Shapiro-Wilk helpers (numpy + stdlib only).

These are the reference implementations that the JVM-side SQL versions
(functions/tails.py, functions/normal.py) are tested against; Spark jobs use
the SQL versions, so no hypothesis test needs Python.
Formulas: regularised incomplete beta by Lentz's continued fraction
(Numerical Recipes), Student t and F tails through it, Royston (1995) for the
Shapiro-Wilk weights and p-value, exact Wilcoxon signed-rank null by counting.
"""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np

_N = NormalDist()


def _betacf(a: float, b: float, x: float) -> float:
    tiny, eps = 1e-300, 3e-16
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 400):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + aa / c
        c = c if abs(c) > tiny else tiny
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b)."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    bt = math.exp(lbt)
    if x < (a + 1.0) / (a + b + 2.0):
        return bt * _betacf(a, b, x) / a
    return 1.0 - bt * _betacf(b, a, 1.0 - x) / b


def t_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) for Student t with df degrees of freedom."""
    if t is None or df is None or not np.isfinite(t) or df <= 0:
        return float("nan")
    return betainc(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    """P(F >= f) for the F(d1, d2) distribution."""
    if f is None or not np.isfinite(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def norm_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


# ---- Shapiro-Wilk (Royston 1995 approximation) ------------------------------

def _poly(c: list[float], x: float) -> float:
    return sum(ci * x**i for i, ci in enumerate(c))


# Fixed coefficients of Royston's published polynomial approximations.
_C1 = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
_C2 = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
_G = [-2.273, 0.459]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]


@lru_cache(maxsize=4096)
def shapiro_weights(n: int) -> tuple[float, ...]:
    """Weights a_1..a_n (antisymmetric) for a sorted sample of size n."""
    if n < 3:
        return tuple()
    if n == 3:
        s = math.sqrt(0.5)
        return (-s, 0.0, s)
    m = np.array([_N.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    ssm = float(np.sum(m * m))
    u = 1.0 / math.sqrt(n)
    an = m[-1] / math.sqrt(ssm) + _poly(_C1, u)
    if n > 5:
        an1 = m[-2] / math.sqrt(ssm) + _poly(_C2, u)
        phi = (ssm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * an**2 - 2 * an1**2)
        a = m / math.sqrt(phi)
        a[-1], a[0] = an, -an
        a[-2], a[1] = an1, -an1
    else:
        phi = (ssm - 2 * m[-1] ** 2) / (1 - 2 * an**2)
        a = m / math.sqrt(phi)
        a[-1], a[0] = an, -an
    return tuple(float(x) for x in a)


def shapiro_p(w: float, n: int) -> float:
    """Royston's p-value for W at sample size n (3 <= n <= 5000)."""
    if w is None or n is None or n < 3 or not np.isfinite(w):
        return float("nan")
    w = min(w, 1.0)
    if n == 3:
        p = 6.0 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return max(p, 0.0)
    if w >= 1.0:
        return 1.0
    y = math.log(1.0 - w)
    if n <= 11:
        gamma = _poly(_G, n)
        if y >= gamma:
            return 1e-19
        y = -math.log(gamma - y)
        mu, sigma = _poly(_C3, n), math.exp(_poly(_C4, n))
    else:
        xx = math.log(n)
        mu, sigma = _poly(_C5, xx), math.exp(_poly(_C6, xx))
    return 1.0 - _N.cdf((y - mu) / sigma)


# ---- Wilcoxon signed-rank exact null ---------------------------------------

@lru_cache(maxsize=128)
def _signrank_counts(n: int) -> np.ndarray:
    """Number of subsets of {1..n} with each rank sum (index = sum)."""
    total = n * (n + 1) // 2
    c = np.zeros(total + 1, dtype=np.float64)
    c[0] = 1.0
    for k in range(1, n + 1):
        c[k:] = c[k:] + c[: total + 1 - k].copy()
    return c


def wilcoxon_exact_two_sided(stat: float, n: int) -> float:
    c = _signrank_counts(n)
    total = c.sum()
    k = int(math.floor(stat))
    p_low = c[: k + 1].sum() / total
    return float(min(1.0, 2.0 * p_low))
