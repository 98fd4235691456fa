"""Regression operators against brute force (explicit refits) on small fixtures."""

import numpy as np
import pandas as pd
import pytest

from prepcast.operators import influence, regression
from prepcast.operators import regression as R


def _fixture(seed=3, n=14):
    rng = np.random.default_rng(seed)
    rows = []
    for g in ("a", "b"):
        x1 = rng.normal(100, 10, n)
        x2 = rng.normal(5, 2, n)
        x3 = (rng.random(n) < 0.3).astype(float)
        y = 3 + 0.5 * x1 - 2 * x2 + 4 * x3 + rng.normal(0, 3, n)
        for i in range(n):
            rows.append({"grp": g, "date": pd.Timestamp("2024-01-01") + pd.Timedelta(days=i),
                         "x1": float(x1[i]), "x2": float(x2[i]) if i != 3 else None, "x3": float(x3[i]),
                         "y": float(y[i])})
    return pd.DataFrame(rows)


def _fit_predict(xtr, ytr, xte):
    """Centred least squares with minimum-norm solution (what sklearn's LinearRegression does)."""
    if xtr.shape[1] == 0:
        return np.full(len(xte), ytr.mean())
    mu, my = xtr.mean(axis=0), ytr.mean()
    b = np.linalg.pinv(xtr - mu) @ (ytr - my)
    return my + (xte - mu) @ b


def _loocv_rmse(x, y):
    errs = []
    for i in range(len(y)):
        m = np.arange(len(y)) != i
        errs.append(y[i] - _fit_predict(x[m], y[m], x[i:i + 1])[0])
    return float(np.sqrt(np.mean(np.square(errs)))), np.array(errs)


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(_fixture())


def test_ols_matches_lstsq(spark, frame):
    pdf = _fixture()
    out = regression.ols_summary(frame, ["x1", "x2"], "y", ["grp"]).toPandas()
    for g, sub in pdf.groupby("grp"):
        sub = sub.dropna(subset=["x1", "x2", "y"])
        x = np.column_stack([np.ones(len(sub)), sub["x1"], sub["x2"]])
        beta = np.linalg.lstsq(x, sub["y"].to_numpy(), rcond=None)[0]
        got = out[out.grp == g].set_index("term")["coef"]
        assert np.allclose([got["const"], got["x1"], got["x2"]], beta, atol=1e-3)
        resid = sub["y"].to_numpy() - x @ beta
        r2 = 1 - resid @ resid / np.sum((sub["y"] - sub["y"].mean()) ** 2)
        assert abs(out[out.grp == g]["r2"].iloc[0] - r2) < 1e-4


def test_loocv_equals_refits(spark, frame):
    pdf = _fixture()
    models = {"base": [], "one": ["x1"], "two": ["x1", "x2"], "three": ["x1", "x2", "x3"]}
    got = regression.loocv_rmse(frame, models, "y", ["grp"]).toPandas()
    for g, sub in pdf.groupby("grp"):
        for name, cols in models.items():
            s = sub.dropna(subset=[*cols, "y"])
            want, _ = _loocv_rmse(s[cols].to_numpy(), s["y"].to_numpy())
            have = got[(got.grp == g) & (got.model == name)]["rmse"].iloc[0]
            assert abs(have - want) < 1e-3, (g, name, have, want)


def test_leverage_one_row_uses_minimum_norm_refit(spark):
    # only one row has x3 = 1: its leverage is 1 and PRESS is 0/0
    pdf = _fixture()
    pdf = pdf[pdf.grp == "a"].copy()
    pdf["x3"] = 0.0
    pdf.iloc[5, pdf.columns.get_loc("x3")] = 1.0
    df = spark.createDataFrame(pdf)
    got = regression.loocv_residuals(df, {"m": ["x1", "x3"]}, "y", ["grp"], keep=["date"]).toPandas()
    want_rmse, want = _loocv_rmse(pdf[["x1", "x3"]].to_numpy(), pdf["y"].to_numpy())
    got = got.sort_values("date")
    assert np.allclose(got["e_loo"].to_numpy(), want, atol=1e-6)


def _forward_reference(df, target, cands, max_features, margin):
    y = df[target].to_numpy()
    selected, remaining = [], list(cands)
    cur, _ = _loocv_rmse(np.zeros((len(y), 0)), y)
    while remaining and len(selected) < max_features:
        best_c, best = None, cur
        for c in remaining:
            trial, _ = _loocv_rmse(df[[*selected, c]].to_numpy(), y)
            if trial < best - margin:
                best, best_c = trial, c
        if best_c is None:
            break
        selected.append(best_c)
        remaining.remove(best_c)
        cur = best
    return selected, cur


@pytest.mark.parametrize("margin", [0.0, 0.5])
def test_forward_selection_matches_reference_rule(spark, frame, margin):
    pdf = _fixture()
    cands = ["x3", "x2", "x1"]
    _, result = regression.forward_selection(frame, "y", cands, ["grp"], max_features=2, margin=margin)
    got = {r["grp"]: (list(r["selected"]), r["rmse"]) for r in result.collect()}
    for g, sub in pdf.groupby("grp"):
        sub = sub.dropna(subset=[*cands, "y"])
        sel, rmse = _forward_reference(sub, "y", cands, 2, margin)
        assert got[g][0] == sel
        assert abs(got[g][1] - rmse) < 1e-3


def test_cooks_distance_formula(spark, frame):
    pdf = _fixture()
    diag = influence.diagnose(frame, "x1", "y", ["grp"]).toPandas()
    for g, sub in pdf.groupby("grp"):
        x = np.column_stack([np.ones(len(sub)), sub["x1"]])
        y = sub["y"].to_numpy()
        beta = np.linalg.lstsq(x, y, rcond=None)[0]
        e = y - x @ beta
        h = np.einsum("ij,jk,ik->i", x, np.linalg.inv(x.T @ x), x)
        mse = e @ e / (len(y) - 2)
        d = e**2 * h / (2 * mse * (1 - h) ** 2)
        got = diag[diag.grp == g].sort_values("date")["cooks_d"].to_numpy()
        assert np.allclose(got, d, atol=1e-8)


def test_saturated_model_has_null_adjusted_r2(spark):
    pdf = pd.DataFrame({"grp": ["a"] * 3, "x1": [1.0, 2.0, 4.0], "x2": [0.0, 1.0, 0.0], "y": [1.0, 3.0, 2.0]})
    out = regression.stepwise_scan(spark.createDataFrame(pdf), ["x1"], ["x2"], "y", ["grp"]).collect()[0]
    assert out["df_resid"] == 0
    assert out["adj_r2"] is None
    assert abs(out["r2"] - 1.0) < 1e-6


def test_forward_selection_handles_leverage_one_candidate(spark):
    # x3 has a single 1 in the sample: adding it gives that row leverage 1
    pdf = _fixture()
    pdf = pdf[pdf.grp == "a"].copy()
    pdf["x3"] = 0.0
    pdf.iloc[4, pdf.columns.get_loc("x3")] = 1.0
    df = spark.createDataFrame(pdf)
    cands = ["x3", "x1"]
    trace, result = regression.forward_selection(df, "y", cands, ["grp"], max_features=2, margin=0.0)
    sub = pdf.dropna(subset=[*cands, "y"])
    sel, rmse = _forward_reference(sub, "y", cands, 2, 0.0)
    r = result.collect()[0]
    assert list(r["selected"]) == sel
    assert abs(r["rmse"] - rmse) < 1e-3
    step1 = {row["candidate"]: row["rmse"] for row in trace.filter("step = 1").collect()}
    want_x3, _ = _loocv_rmse(sub[["x3"]].to_numpy(), sub["y"].to_numpy())
    assert abs(step1["x3"] - want_x3) < 1e-3


def test_forward_selection_with_base_features(spark, frame):
    pdf = _fixture()
    cands = ["x3", "x2"]
    _, result = regression.forward_selection(frame, "y", cands, ["grp"], base_features=["x1"], max_features=2, margin=0.0)
    got = {r["grp"]: (list(r["selected"]), r["rmse"]) for r in result.collect()}
    for g, sub in pdf.groupby("grp"):
        sub = sub.dropna(subset=["x1", *cands, "y"])
        y = sub["y"].to_numpy()
        cur, _ = _loocv_rmse(sub[["x1"]].to_numpy(), y)
        best_c, best = None, cur
        for c in cands:
            trial, _ = _loocv_rmse(sub[["x1", c]].to_numpy(), y)
            if trial < best:
                best, best_c = trial, c
        want = ["x1"] + ([best_c] if best_c else [])
        assert got[g][0] == want
        assert abs(got[g][1] - best) < 1e-3


def test_loocv_on_tiny_groups_does_not_fail(spark):
    pdf = pd.DataFrame({"grp": ["a", "b", "b"], "x1": [1.0, 2.0, 3.0], "y": [1.0, 2.0, 2.5]})
    out = regression.loocv_rmse(spark.createDataFrame(pdf), {"m": ["x1"], "c": []}, "y", ["grp"]).collect()
    assert {(r["grp"], r["model"]) for r in out} >= {("b", "c")}


def test_one_feature_leverage_one_row_in_jvm_path(spark):
    pdf = _fixture()
    pdf = pdf[pdf.grp == "a"].copy()
    pdf["x3"] = 2.0
    pdf.iloc[6, pdf.columns.get_loc("x3")] = 5.0  # the only row with its x value: leverage 1
    df = spark.createDataFrame(pdf)
    got = regression.loocv_residuals(df, {"m": ["x3"]}, "y", ["grp"], keep=["date"]).toPandas().sort_values("date")
    _, want = _loocv_rmse(pdf[["x3"]].to_numpy(), pdf["y"].to_numpy())
    assert np.allclose(got["e_loo"].to_numpy(), want, atol=1e-6)
    j = regression.loocv_residuals(df, {"m": ["x3"]}, "y", ["grp"])
    assert "Python" not in j._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("level", [0.0, 1e6, 1e8])
def test_level_of_the_data_costs_no_digits(spark, level):
    rng = np.random.default_rng(5)
    x, z = rng.normal(0, 1, 60) + level, rng.normal(0, 1, 60) - 3 * level
    y = 2 * (x - level) - 0.5 * (z + 3 * level) + rng.normal(0, 1, 60) + level
    df = spark.createDataFrame([("s", float(a), float(b), float(c)) for a, b, c in zip(x, z, y)], "store_id string, x double, z double, y double")
    a = np.column_stack([np.ones(60), x - x.mean(), z - z.mean()])
    beta = np.linalg.lstsq(a, y - y.mean(), rcond=None)[0]
    got = {r["term"]: r["coef"] for r in R.ols_long(R.model_grams(df, {"m": ["x", "z"]}, "y", ["store_id"]), ["store_id"]).collect()}
    assert abs(got["x"] - beta[1]) < 1e-6 * abs(beta[1]) and abs(got["z"] - beta[2]) < 1e-6 * abs(beta[2])
    h = np.einsum("ij,jk,ik->i", a, np.linalg.inv(a.T @ a), a)
    loo = ((y - y.mean()) - a @ beta) / (1 - h)
    rmse = R.loocv_rmse(df, {"m": ["x", "z"]}, "y", []).first()["rmse"]
    assert abs(rmse - np.sqrt(np.mean(loo**2))) < 1e-3


def test_rank_sets_the_degrees_of_freedom(spark):
    rng = np.random.default_rng(6)
    rows = [("s", float(a), 7.0, 2 * float(a), float(b)) for a, b in zip(rng.normal(0, 1, 20), rng.normal(0, 1, 20))]
    df = spark.createDataFrame(rows, "store_id string, x double, c double, twice double, y double")
    for cols in (["x", "c"], ["x", "twice"], ["x"]):
        r = R.ols_summary(df, cols, "y", ["store_id"]).filter("term = 'const'").first()
        assert r["df_resid"] == 18 and r["k"] == 1
    fit = R.loocv_residuals(df, {"m": ["c"]}, "y", ["store_id"]).first()
    assert fit["p"] == 1


def test_forward_selection_single_series_and_tiny_margins(spark):
    rng = np.random.default_rng(8)
    x, z = rng.normal(0, 1, 40), rng.normal(0, 1, 40)
    y = 3 * x + 1e-5 * z * 0
    df = spark.createDataFrame([("s", float(a), float(a + 1e-6 * b), float(c + 0.01 * b)) for a, b, c in zip(x, z, y)], "store_id string, x double, near double, y double")
    a = R.forward_selection(df, "y", ["x", "near"], [], max_features=1)[1].first()
    b = R.forward_selection(df, "y", ["x", "near"], ["store_id"], max_features=1)[1].first()
    rmse = {c: R.loocv_residuals(df, {"m": [c]}, "y", []).selectExpr("sqrt(avg(e_loo * e_loo)) r").first()["r"] for c in ("x", "near")}
    assert a["selected"] == b["selected"] == [min(rmse, key=rmse.get)] and a["rmse"] == b["rmse"]
