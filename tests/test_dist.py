"""Known answers for the tail probabilities and test helpers."""

import math

import numpy as np

from tests import dist_check as dist


def test_paired_t_pvalue_matches_published():
    # published H3 result: t = 2.68 with 22 df -> p = 0.0135 (rounded t)
    assert abs(dist.t_two_sided(2.68, 22) - 0.01368) < 5e-5


def test_f_pvalues_match_published():
    assert abs(dist.f_sf(7.138, 2, 14) - 0.00729) < 5e-5
    # F(2, 2): p = 1 - R^2 when F = R^2 / (1 - R^2)
    r2 = 0.971
    assert abs(dist.f_sf(r2 / (1 - r2), 2, 2) - (1 - r2)) < 1e-9


def test_t_symmetry_and_limits():
    assert abs(dist.t_two_sided(0.0, 10) - 1.0) < 1e-12
    assert abs(dist.t_two_sided(-2.0, 10) - dist.t_two_sided(2.0, 10)) < 1e-15
    # large df approaches the normal
    assert abs(dist.t_two_sided(1.96, 1e7) - 0.05) < 1e-4


def test_wilcoxon_exact_null():
    # n = 10, T = 5 -> 2 * 10/1024
    assert abs(dist.wilcoxon_exact_two_sided(5, 10) - 20 / 1024) < 1e-12
    # full support sums to 1
    c = dist._signrank_counts(8)
    assert c.sum() == 2**8


def test_shapiro_weights_properties():
    for n in (3, 4, 5, 6, 11, 12, 50, 500):
        a = np.array(dist.shapiro_weights(n))
        assert abs(np.sum(a * a) - 1.0) < 1e-6
        assert np.allclose(a, -a[::-1])


def test_shapiro_normal_vs_skewed():
    rng = np.random.default_rng(7)
    for sample, expect_normal in ((rng.normal(size=200), True), (rng.exponential(size=200) ** 2, False)):
        x = np.sort(sample)
        a = np.array(dist.shapiro_weights(len(x)))
        w = (a @ x) ** 2 / np.sum((x - x.mean()) ** 2)
        p = dist.shapiro_p(w, len(x))
        assert 0 < w <= 1
        assert (p > 0.05) == expect_normal


def test_betainc_edges():
    assert dist.betainc(2, 3, 0.0) == 0.0
    assert dist.betainc(2, 3, 1.0) == 1.0
    # I_x(1, 1) = x
    assert math.isclose(dist.betainc(1.0, 1.0, 0.3), 0.3, rel_tol=1e-12)
