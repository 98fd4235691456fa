"""Sums of expected normal order statistics over a range of ranks, as SQL expressions.

m(i) is the inverse normal CDF of (i - 3/8) / (n + 1/4). The sum of m or m**2 over many
ranks is an integral with closed form (the integral of z dPhi is -phi, that of z**2 dPhi is
Phi - z * phi) and the Euler-Maclaurin terms of its midpoint rule. Near both
ends of the sample, where the terms fall slowly, and for short ranges the ranks are summed
one by one: at most ``2 * EDGE`` of them, whatever the range. So a value tied a hundred
million times costs what a value tied a hundred times does.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.functions.normal import norm_ppf_sql, norm_sf_sql

EDGE = 64


def _exact_z(q: str) -> str:
    """One Newton step from the rational approximation ``q.z`` at probability ``q.p`` (complement ``q.t``): differences need all digits."""
    density = f"(exp(-{q}.z * {q}.z / 2) / sqrt(2 * pi()))"
    low = f"(({norm_sf_sql(f'(-{q}.z)')} - {q}.p) / {density})"
    high = f"(({q}.t - {norm_sf_sql(f'{q}.z')}) / {density})"
    return f"({q}.z - CASE WHEN {q}.p < 0.5 THEN {low} ELSE {high} END)"


def rank_sums(df: DataFrame, lo: str, hi: str, n: str) -> DataFrame:
    """``df`` with ``_m1`` and ``_m2``: the sums of m(i) and m(i)**2 over the ranks from ``lo`` to ``hi`` (columns) of ``n``."""
    short = f"({hi} - {lo} < {2 * EDGE})"
    single = (f"CASE WHEN {short} THEN sequence({lo}, {hi}) ELSE concat("
              f"IF({lo} <= {EDGE}, sequence({lo}, least({hi}, {EDGE}L)), array()), "
              f"IF({hi} > {n} - {EDGE}, sequence(greatest({lo}, {n} - {EDGE} + 1), {hi}), array())) END")
    ms = f"transform(transform({single}, i -> (i - 0.375D) / ({n} + 0.25D)), p -> {norm_ppf_sql('p')})"
    # the two borders of the integral, each bound to a name step by step (lambdas) so that no expression is repeated
    big = f"({n} + 0.25D)"
    first, last = f"greatest({lo}, {EDGE + 1})", f"least({hi}, {n} - {EDGE})"
    borders = f"IF({short} OR {first} > {last}, CAST(array() AS array<double>), array({first} - 0.5D, {last} + 0.5D))"
    at = f"transform({borders}, x -> named_struct('x', x, 'p', (x - 0.375D) / {big}, 't', ({big} - x + 0.375D) / {big}))"
    at = f"transform({at}, b -> named_struct('x', b.x, 'p', b.p, 't', b.t, 'z', {norm_ppf_sql('b.p')}))"
    at = f"transform({at}, q -> named_struct('x', q.x, 'z', {_exact_z('q')}))"
    at = f"transform({at}, q -> named_struct('x', q.x, 'z', q.z, 'f', {big} * exp(-q.z * q.z / 2) / sqrt(2 * pi())))"
    # per border: the integrals' values and the correction terms of m and of m**2
    m1 = "-q.f - 1 / q.f / 24 + 7 * (1 + 2 * q.z * q.z) / pow(q.f, 3) / 5760"
    m2 = "q.x - q.z * q.f - 2 * q.z / q.f / 24 + 7 * 4 * q.z * (2 + q.z * q.z) / pow(q.f, 3) / 5760"
    at = f"transform({at}, q -> named_struct('m1', {m1}, 'm2', {m2}))"
    d = df.withColumns({"_single": F.expr(ms), "_at": F.expr(at)})
    sums = {"_m1": "m", "_m2": "m * m"}
    return d.withColumns({
        c: F.expr(f"aggregate(_single, 0D, (s, m) -> s + {x}) + coalesce(get(_at, 1).{c[1:]} - get(_at, 0).{c[1:]}, 0D)") for c, x in sums.items()
    }).drop("_single", "_at")
