"""p-values of the rank tests as SQL text, evaluated JVM-side by Spark and by
the DuckDB oracle alike (one row per group; no Python).

* Shapiro-Wilk: Royston's (1995) normalising transformation of W, then the
  normal upper tail.
* Wilcoxon signed-rank: exact null distribution by the subset-sum recursion
  c_k[s] = c_{k-1}[s] + c_{k-1}[s-k] when n <= 50 without ties, else the normal
  approximation with tie correction.
"""

from __future__ import annotations

from prepcast.functions.normal import _lit, norm_sf_sql

# Fixed coefficients of Royston's normalising transformation of W.
_G = [-2.273, 0.459]
_C3 = [0.5440, -0.39978, 0.025054, -6.714e-4]
_C4 = [1.3822, -0.77857, 0.062767, -0.0020322]
_C5 = [-1.5861, -0.31082, -0.083751, 0.0038915]
_C6 = [-0.4803, -0.082676, 0.0030302]


def _poly(coefs: list[float], x: str) -> str:
    out = _lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = f"({out} * {x} + {_lit(c)})"
    return out


def shapiro_p_sql(w: str, n: str) -> str:
    """Royston's p-value of W at sample size n (NULL below 3). Royston fitted it up to n = 5000;
    beyond that it is an extrapolation, as in the usual libraries."""
    y = f"ln(1.0 - {w})"
    gamma = _poly(_G, n)
    small = norm_sf_sql(f"((-ln({gamma} - {y}) - {_poly(_C3, n)}) / exp({_poly(_C4, n)}))")
    large = norm_sf_sql(f"(({y} - {_poly(_C5, f'ln({n})')}) / exp({_poly(_C6, f'ln({n})')}))")
    n3 = f"GREATEST(0.0, 6.0 / pi() * (asin(sqrt(LEAST({w}, 1.0))) - asin(sqrt(0.75))))"
    return (f"(CASE WHEN {w} IS NULL OR {n} < 3 THEN NULL "
            f"WHEN {n} = 3 THEN {n3} WHEN {w} >= 1.0 THEN 1.0 "
            f"WHEN {n} <= 11 AND {y} >= {gamma} THEN 1e-19 "
            f"WHEN {n} <= 11 THEN {small} ELSE {large} END)")


def wilcoxon_p_sql(stat: str, n: str, z: str, exact: str, engine: str = "spark") -> str:
    """Two-sided signed-rank p: exact counts when ``exact``, else 2 * P(Z > |z|)."""
    if engine == "spark":
        counts = (f"aggregate(sequence(1, CAST({n} AS INT)), array(CAST(1.0 AS DOUBLE)), (c, k) -> "
                  f"transform(sequence(0, CAST(k * (k + 1) / 2 AS INT)), s -> "
                  f"coalesce(get(c, s), 0D) + IF(s >= k, coalesce(get(c, s - k), 0D), 0D)))")
        low = f"aggregate(slice({counts}, 1, CAST(floor({stat}) AS INT) + 1), 0D, (a, v) -> a + v)"
    else:
        counts = (f"list_reduce(range(1, CAST({n} AS BIGINT) + 1), lambda c, k: list_transform("
                  f"range(0, k * (k + 1) // 2 + 1), lambda s: coalesce(c[s + 1], 0.0) + "
                  f"CASE WHEN s >= k THEN coalesce(c[s - k + 1], 0.0) ELSE 0.0 END), [1.0]::DOUBLE[])")
        low = f"list_sum(({counts})[1:CAST(floor({stat}) AS BIGINT) + 1])"
    exact_p = f"LEAST(1.0, 2.0 * {low} / pow(2.0, {n}))"
    approx_p = f"(2.0 * {norm_sf_sql(f'abs({z})')})"
    return (f"(CASE WHEN {stat} IS NULL OR {n} IS NULL OR {n} = 0 THEN NULL "
            f"WHEN {exact} THEN {exact_p} ELSE {approx_p} END)")


# Fixed Lanczos coefficients (g = 7) of the logarithm of the gamma function.
_LANCZOS = [0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
            12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7]
FRACTION_STEPS = 2000  # terms of the continued fraction; enough for degrees of freedom in the millions


def _lgamma_sql(z: str) -> str:
    """ln Gamma(z) for z >= 0.5 (Spark SQL)."""
    total = _lit(_LANCZOS[0]) + "".join(f" + {_lit(c)} / ({z} - 1D + {i})" for i, c in enumerate(_LANCZOS) if i)
    return f"(0.9189385332046727D + ({z} - 0.5D) * ln({z} + 6.5D) - ({z} + 6.5D) + ln({total}))"


def betainc_sql(a: str, b: str, x: str, y: str) -> str:
    """Regularised incomplete beta I_x(a, b) with y = 1 - x (Spark SQL), the same for all a, b >= 0.5.

    The power front is taken in logs and the continued fraction runs a fixed
    number of steps (modified Lentz), so work and memory don't depend on a and b.
    """
    m = "((j + 1) div 2)"
    step = (f"IF(j % 2 = 1, {m} * (q.b - {m}) * q.x / ((q.a - 1 + 2 * {m}) * (q.a + 2 * {m})), "
            f"-(q.a + {m}) * (q.a + q.b + {m}) * q.x / ((q.a + 2 * {m}) * (q.a + 1 + 2 * {m})))")
    first = "(1D / (1D - (q.a + q.b) * q.x / (q.a + 1D)))"
    fraction = (f"aggregate(sequence(1, {FRACTION_STEPS}), named_struct('c', 1D, 'd', {first}, 'h', {first}), (s, j) -> "
                f"named_struct('c', 1D + {step} / s.c, 'd', 1D / (1D + {step} * s.d), "
                f"'h', s.h * (1D + {step} / s.c) / (1D + {step} * s.d)), s -> s.h)")
    front = f"exp(q.a * ln(q.x) + q.b * ln(q.y) + {_lgamma_sql('(q.a + q.b)')} - {_lgamma_sql('q.a')} - {_lgamma_sql('q.b')})"
    swap = f"{x} >= ({a} + 1D) / ({a} + {b} + 2D)"
    args = (f"named_struct('a', CAST(IF({swap}, {b}, {a}) AS DOUBLE), 'b', CAST(IF({swap}, {a}, {b}) AS DOUBLE), "
            f"'x', CAST(IF({swap}, {y}, {x}) AS DOUBLE), 'y', CAST(IF({swap}, {x}, {y}) AS DOUBLE), 'swap', {swap})")
    value = f"IF(q.x <= 0D, 0D, {front} * {fraction} / q.a)"
    return f"element_at(transform(array({args}), q -> IF(q.swap, 1D - {value}, {value})), 1)"


def t_p_sql(t: str, nu: str) -> str:
    """Two-sided Student-t p for any positive df (Spark SQL)."""
    beta = betainc_sql(f"({nu} / 2D)", "0.5D", f"({nu} / ({nu} + {t} * {t}))", f"({t} * {t} / ({nu} + {t} * {t}))")
    return f"(CASE WHEN {t} IS NULL OR {nu} IS NULL OR {nu} <= 0 THEN NULL ELSE {beta} END)"


def f_p_sql(f: str, d1: str, d2: str) -> str:
    """Upper F tail P(F > f) for any positive df (Spark SQL)."""
    beta = betainc_sql(f"({d2} / 2D)", f"({d1} / 2D)", f"({d2} / ({d2} + {d1} * {f}))", f"({d1} * {f} / ({d2} + {d1} * {f}))")
    return (f"(CASE WHEN {f} IS NULL OR {d1} IS NULL OR {d2} IS NULL OR {d1} <= 0 OR {d2} <= 0 THEN NULL "
            f"WHEN {f} <= 0 THEN 1.0 ELSE {beta} END)")
