"""Mined negatives and score intervals against all exact scores."""

import math

import numpy as np
import pytest

from prepcast.llm import hard_negatives
from prepcast.llm.hard_negatives import BOUND, Coder, mine

SCHEMA = "vec_id long, label int, embedding array<float>, anchor int, score int, rid int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95):
    live = [(i, y, [max(-BOUND, min(BOUND, math.floor(256 * float(np.float32(c))))) for c in x]) for i, y, x in rows if y is not None and x is not None and all(c is not None and math.isfinite(c) for c in x)]
    top = lambda xs, k: sorted(xs, key=lambda t: (-t[0], t[1] is None, t[1] or 0, t[2]))[:k]
    out = []
    for a, (i, y, x) in enumerate(live):
        if i is None or i % every:
            continue
        score = [(sum(p * q for p, q in zip(x, z)), j, b, w) for b, (j, w, z) in enumerate(live) if b != a]
        for ps, pi, _, w in top([s for s in score if s[3] == y], positives):
            fits = [s for s in score if s[3] != y and low * ps <= 100 * s[0] <= high * ps]
            out += [(i, pi, k + 1, ni, ps, ns) for k, (ns, ni, _, _) in enumerate(top(fits, negatives))]
    return sorted(out, key=str)


def vectors(n, size, seed=1, labels=4):
    rng = np.random.default_rng(seed)
    centre = rng.standard_normal((labels, size)) * 0.7
    label = rng.integers(0, labels, n)
    x = centre[label] + rng.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    return [(i, int(y), [float(np.float32(c)) for c in v]) for i, (y, v) in enumerate(zip(label, x))]


def found(spark, rows, parts=5, **how):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in mine(df, **how).collect()), key=str)


@pytest.mark.parametrize("size,step", [(64, 2048), (20, 70), (100, 300)])
def test_all_scores(spark, monkeypatch, size, step):
    monkeypatch.setattr(hard_negatives, "STEP", step)
    rows = vectors(700, size)
    assert found(spark, rows, every=20) == brute(rows, every=20)


def test_many_groups_and_slices(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "GROUP", 30)
    rows = vectors(3000, 16, 3)
    assert found(spark, rows, parts=7, every=25) == brute(rows, every=25)


def test_nulls_ties_repeats_and_odd_vectors(spark):
    rows = vectors(120, 8, 5, 3)
    same = rows[7][2]
    rows += [(1000 + i, i % 3, same) for i in range(60)]  # one vector under all labels
    rows += [(200, None, same), (250, 1, None), (300, 1, [None] * 8), (350, 1, [float("nan")] * 8), (400, 1, [float("inf")] + [0.0] * 7)]
    rows += [(450, 1, []), (500, 2, same[:3]), (550, 0, [1e30] * 8), (None, 1, same), (None, 2, same), (600, 0, [0.0] * 8), (650, 77, same)]
    assert found(spark, rows) == brute(rows)
    twice = rows + [r for r in rows if r[0] in (0, 50, 3, 4)]
    assert found(spark, twice) == brute(twice)
    assert found(spark, []) == [] and found(spark, [(1, 1, same)]) == []


def test_intervals_hold_every_score():
    rng = np.random.default_rng(2)
    for size in (3, 64, 130):
        c = Coder(size)
        a, x = (np.floor(256 * rng.standard_normal((n, size)) * rng.choice([0.01, 1, 50], (n, 1))).astype(np.int64) for n in (40, 300))
        stages, norm = c.anchors(a)
        mid, half = c.interval(stages, norm, np.arange(40), *c.rows(x))
        assert (np.abs(a @ x.T - mid) <= half).all()
        both = norm[:, None] * np.linalg.norm(x, axis=1)[None, :]
        assert np.median(half / np.maximum(both, 1)) < 0.25  # the intervals say something
