"""Merged moments against numpy on the complete cases of every pair and model."""

import numpy as np
import pandas as pd
import pytest

from prepcast.operators import moments
from prepcast.operators.corr import corr_matrix
from prepcast.operators.moments import model_moments, pair_moments
from prepcast.operators.regression import model_grams, ols_long, single_feature_scan


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(5)
    n = 4000
    x = rng.normal(0, 1, (n, 4)) @ rng.normal(0, 1, (4, 4)) + np.array([1e9, -5.0, 0.0, 3e4])
    pdf = pd.DataFrame(x, columns=list("abcd")).mask(rng.random((n, 4)) < 0.15)
    pdf["e"], pdf["f"] = 7.0, np.nan  # constant, and never there
    pdf["grp"] = rng.choice(["p", "q", None], n, p=[0.9, 0.05, 0.05])
    pdf["day"] = np.where(rng.random(n) < 0.5, 1, 2)
    df = spark.createDataFrame([tuple(None if isinstance(v, float) and np.isnan(v) else v for v in r) for r in pdf.itertuples(index=False)],
                               "a double, b double, c double, d double, e double, f double, grp string, day int").repartition(6)
    return pdf, df


def test_pair_moments(sample, monkeypatch):
    pdf, df = sample
    monkeypatch.setattr(moments, "HELD", 2)  # groups are sent on many times over
    got = {(r["grp"], r["day"], r["x"], r["y"]): r for r in pair_moments(df, list("abcdef"), ["grp", "day"]).collect()}
    seen = 0
    for (g, day), sub in pdf.fillna({"grp": "none"}).groupby(["grp", "day"]):
        for i, x in enumerate("abcdef"):
            for y in "abcdef"[i:]:
                r = got[None if g == "none" else g, day, x, y]
                both = sub.loc[sub[x].notna() & sub[y].notna(), list(dict.fromkeys([x, y]))]
                u, v = (both[c].to_numpy() for c in (x, y))
                assert r["n"] == len(both)
                if len(both):
                    want = [((u - u.mean()) ** 2).sum(), ((v - v.mean()) ** 2).sum(), ((u - u.mean()) * (v - v.mean())).sum()]
                    assert np.allclose([r["sxx"], r["syy"], r["sxy"]], want, rtol=1e-5, atol=1e-4)
                seen += 1
    assert seen == len(got) == 6 * 21


def test_matrix_and_scan_of_a_single_series(sample):
    pdf, df = sample
    one, sub = df.where("grp = 'p'"), pdf[pdf.grp == "p"]
    r = {(x["x"], x["y"]): (x["r"], x["n"]) for x in corr_matrix(one, list("abcdef"), []).collect()}
    want = sub[list("abcdef")].corr()
    for x in "abcd":
        for y in "abcd":
            assert r[x, y][0] == pytest.approx(want.loc[x, y], abs=2e-6) and r[x, y] == r[y, x]
    assert r["a", "e"][0] is None and r["a", "f"] == (None, 0) and len(r) == 36
    scan = {x["feature"]: x for x in single_feature_scan(one, list("bcdef"), "a", []).collect()}
    for x in "bcd":
        both = sub[["a", x]].dropna()
        slope = np.polyfit(both[x], both["a"] - 1e9, 1)[0]
        assert scan[x]["slope"] == pytest.approx(slope, abs=1e-3) and scan[x]["n"] == len(both)
    assert scan["e"]["r2"] is None and scan["f"]["n"] == 0


def test_model_moments_give_the_fits_of_the_two_pass_sums(sample):
    _, df = sample
    models = {"c": ["b", "c"], "d": ["b", "d"], "const": [], "e": ["b", "e"]}
    a, b = ({(r["grp"], r["model"], r["term"]): r for r in ols_long(f(df.where("grp IS NOT NULL"), models, "a", ["grp"]), ["grp"]).collect()} for f in (model_moments, model_grams))
    assert set(a) == set(b)
    for k, r in a.items():
        for c in ("coef", "se", "t", "r2", "F", "n", "df_resid"):
            assert (r[c] is None) == (b[k][c] is None) and (r[c] is None or r[c] == pytest.approx(b[k][c], rel=1e-4, abs=1e-6)), (k, c)
