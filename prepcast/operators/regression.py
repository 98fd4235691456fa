"""Grouped OLS, feature scans, LOOCV and forward selection from Gram matrices.

Plan shape (per group = store, all groups at once):

1. One aggregate computes, per group and per candidate model, the masked
   sums n, Σx, Σxxᵀ, Σxy, Σy² over that model's complete cases. Many models
   share one pass over the data.
2. Each (group, model) system is solved in centred coordinates: in closed
   form on the JVM for models with at most one feature, otherwise by a small
   Arrow-batched helper (at most ~16 unknowns). Only these sufficient
   statistics reach Python.
3. LOOCV never refits: the held-out residual is e / (1 - h) with leverage
   h = 1/n + (x - mu)ᵀ Sxx⁻¹ (x - mu) (PRESS). It is computed in a JVM-side
   pass over the rows joined to their group's coefficients; rows with
   leverage 1 (where PRESS is 0/0) get the exact minimum-norm refit without
   the row (a closed form for one feature, a downdated pseudo-inverse solve
   otherwise).
4. Forward selection is a driver loop of at most ``max_features`` steps; each
   step is one narrow pass scoring every remaining candidate of every group,
   and the running-best rule is a fold over the group's candidate list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prepcast.functions.columns import join_groups, rnd, single_series
from prepcast.functions.tails import f_p_sql, t_p_sql
from prepcast.operators.moments import model_moments, pair_moments

DIGITS = 4


def _tri_index(m: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(m) for j in range(i, m)]


def _sym(vec, m: int) -> np.ndarray:
    a = np.zeros((m, m))
    for v, (i, j) in zip(vec, _tri_index(m)):
        a[i, j] = a[j, i] = v
    return a


# --------------------------------------------------------------------------
# 1. Gram aggregate
# --------------------------------------------------------------------------

def column_means(df: DataFrame, names: list[str], groups: list[str]) -> DataFrame:
    """(groups, ``_c_<name>``): each group's mean of each column, 0 where it has no value."""
    return df.groupBy(*groups).agg(*[F.coalesce(F.avg(F.col(cname).cast("double")), F.lit(0.0)).alias(f"_c_{cname}") for cname in names])


def model_columns(models: dict[str, list[str]], target: str) -> list[str]:
    return list(dict.fromkeys([cname for cols in models.values() for cname in cols] + [target]))


def model_grams(df: DataFrame, models: dict[str, list[str]], target: str, groups: list[str], about: DataFrame | None = None) -> DataFrame:
    """One row per (group, model): ``n`` and the upper triangle of [1, x..., y]ᵀ[1, x..., y].

    Each model uses its own complete cases (rows where its columns and the
    target are all non-null). The mask is applied once per term in a
    projection (a masked term is NULL outside the model's complete cases), so
    the aggregate itself is a flat list of sums of products.

    The sums are taken about ``shift``, the group's mean of each column and of
    the target, so large means cancel nothing: centred second moments keep
    their digits whatever the level of the data. ``about`` gives other shifts (in the form of
    ``column_means``): sums about equal shifts can be added and subtracted.
    """
    names = model_columns(models, target)
    df = join_groups(df, column_means(df, names, groups) if about is None else about, groups)
    ok_cols, term_cols = [], []
    for k, (_, cols) in enumerate(models.items()):
        mask = F.col(target).isNotNull()
        for cname in cols:
            mask = mask & F.col(cname).isNotNull()
        ok_cols.append(mask.alias(f"_ok{k}"))
    staged = df.select(*groups, *names, *[f"_c_{cname}" for cname in names], *ok_cols)
    for k, (_, cols) in enumerate(models.items()):
        raw = [F.lit(1.0)] + [F.col(cname).cast("double") - F.col(f"_c_{cname}") for cname in [*cols, target]]
        term_cols += [F.when(F.col(f"_ok{k}"), t).alias(f"_t{k}_{i}") for i, t in enumerate(raw)]
    masked = staged.select(*groups, *[f"_c_{cname}" for cname in names], *term_cols)
    aggs = []
    for k, (name, cols) in enumerate(models.items()):
        m = len(cols) + 2
        t = [F.col(f"_t{k}_{i}") for i in range(m)]
        aggs.append(F.struct(
            F.lit(name).alias("model"),
            F.array(*[F.lit(cname) for cname in cols]).cast("array<string>").alias("terms"),
            F.count(t[0]).alias("n"),
            F.array(*[F.coalesce(F.sum(t[i] * t[j]), F.lit(0.0)) for i, j in _tri_index(m)]).alias("gram"),
            F.array(*[F.min(f"_c_{cname}") for cname in [*cols, target]]).alias("shift"),
        ).alias(f"_m{k}"))
    wide = masked.groupBy(*groups).agg(*aggs)
    return wide.select(*groups, F.explode(F.array(*[F.col(f"_m{k}") for k in range(len(models))])).alias("_g")).select(
        *groups, "_g.model", "_g.terms", "_g.n", "_g.gram", "_g.shift"
    )


# --------------------------------------------------------------------------
# 2. Solve (small helper, one call per (group, model) row)
# --------------------------------------------------------------------------

RANK_TOL = 1e-10  # a column counts as constant below this share of its own scale


def _pinv(sxx: np.ndarray, raw: np.ndarray, shift, n: int) -> tuple[np.ndarray, int]:
    """Pseudo-inverse and rank of the centred cross products, on columns scaled to unit length.

    A column whose spread vanishes beside its level, or that others determine,
    adds nothing to the rank."""
    k = len(sxx)
    if k == 0:
        return np.zeros((0, 0)), 0
    level = np.asarray(shift, dtype=float) ** 2 * n + np.diag(raw)
    size = np.sqrt(np.maximum(np.diag(sxx), 0.0))
    live = size > np.sqrt(np.maximum(level, 0.0)) * 1e-12
    unit = np.where(live, size, 1.0)
    scaled = np.where(np.outer(live, live), sxx / np.outer(unit, unit), 0.0)
    rank = int(np.linalg.matrix_rank(scaled, tol=RANK_TOL, hermitian=True))
    if rank == k:
        return np.linalg.inv(scaled) / np.outer(unit, unit), rank
    kept = np.where(np.outer(live, live), sxx, 0.0)  # minimum norm in the columns' own units
    return np.linalg.pinv(kept, rcond=RANK_TOL, hermitian=True), rank


def _solve(gram, n: int, k: int, shift) -> dict:
    """OLS summary from the Gram vector of [1, x_1..x_k, y] about ``shift``.

    Solved in centred coordinates (Sxx = Σxxᵀ - nμμᵀ), which keeps the
    leverage and residuals accurate when the columns have large means.
    A singular Sxx is handled by the pseudo-inverse (minimum-norm fit).
    """
    m = k + 2
    a = _sym(np.asarray(gram, dtype=float), m)
    out = {"n": int(n), "k": k, "beta": None, "se": None, "r2": None, "adj_r2": None, "F": None,
           "df_resid": int(n) - (k + 1), "sse": None, "mu": None, "sinv": None, "mse": None}
    if n == 0:
        return out
    mu = a[0, 1 : k + 1] / n
    ybar = a[0, k + 1] / n
    sxx = a[1 : k + 1, 1 : k + 1] - n * np.outer(mu, mu)
    sxy = a[1 : k + 1, k + 1] - n * mu * ybar
    syy = float(a[k + 1, k + 1] - n * ybar * ybar)
    sinv, rank = _pinv(sxx, a[1 : k + 1, 1 : k + 1], shift[:k], n)
    out["df_resid"] = int(n) - 1 - rank
    out["k"] = rank
    b = sinv @ sxy if k > 0 else np.zeros(0)
    shift = np.asarray(shift, dtype=float)
    mu, ybar = mu + shift[:k], ybar + shift[k]
    b0 = ybar - mu @ b
    sse = max(syy - float(b @ sxy), 0.0)
    beta = np.concatenate([[b0], b])
    out.update(beta=beta, sse=sse, mu=mu, sinv=sinv)
    dfr = out["df_resid"]
    if dfr > 0:
        out["mse"] = sse / dfr
    if syy > 0:
        # no residual degrees of freedom: the fit interpolates, R^2 = 1 (adjusted R^2 undefined)
        r2 = 1.0 if dfr <= 0 else 1.0 - sse / syy
        out["r2"] = r2
        if dfr > 0:
            out["adj_r2"] = 1.0 - (1.0 - r2) * (n - 1) / dfr
            sigma2 = sse / dfr
            var_b = np.diag(sinv) * sigma2 if k > 0 else np.zeros(0)
            var_b0 = sigma2 * (1.0 / n + float(mu @ sinv @ mu)) if k > 0 else sigma2 / n
            out["se"] = np.sqrt(np.maximum(np.concatenate([[var_b0], var_b]), 0.0))
            if rank > 0 and sigma2 > 0:
                out["F"] = ((syy - sse) / rank) / sigma2
    return out


SUMMARY_SCHEMA = ("model string, term string, coef double, se double, t double, "
                  "n long, k int, r2 double, adj_r2 double, F double, df_resid long")


def _rows_of(pdf: pd.DataFrame, groups: list[str]):
    for rec in pdf.to_dict("records"):
        yield rec, {g: rec[g] for g in groups}


def ols_long(grams: DataFrame, groups: list[str]) -> DataFrame:
    """One pass over the (group, model) Gram rows: one row per (group, model, term)
    with the coefficient, its standard error and t, and the model's fit statistics."""
    gfields = [grams.schema[g] for g in groups]
    schema = T.StructType(gfields + T._parse_datatype_string(SUMMARY_SCHEMA).fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rec, key in _rows_of(pdf, groups):
                terms = list(rec["terms"])
                s = _solve(rec["gram"], rec["n"], len(terms), rec["shift"])
                if s["beta"] is None:
                    continue
                fit = {"n": s["n"], "k": s["k"], "r2": s["r2"], "adj_r2": s["adj_r2"], "F": s["F"],
                       "df_resid": s["df_resid"]}
                for i, name in enumerate(["const", *terms]):
                    se = None if s["se"] is None else float(s["se"][i])
                    b = float(s["beta"][i])
                    rows.append({**key, "model": rec["model"], "term": name, "coef": b, "se": se,
                                 "t": (b / se) if se not in (None, 0.0) else None, **fit})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return grams.mapInPandas(run, schema)


def ols_tables(grams: DataFrame, groups: list[str]) -> tuple[DataFrame, DataFrame]:
    """(coefficient table, fit table) for every (group, model) Gram row, from one pass."""
    long = ols_long(grams, groups)
    coef = long.select(*groups, "model", "term", "coef", "se", "t")
    fit = long.filter(F.col("term") == "const").select(*groups, "model", "n", "k", "r2", "adj_r2", "F", "df_resid")
    return coef, fit


def _round(c: Column) -> Column:
    return rnd(c, DIGITS)


def ols_summary(df: DataFrame, cols: list[str], target: str, groups: list[str], model: str = "ols",
                with_p: bool = True) -> DataFrame:
    """Long summary: one row per (group, term) with coef / se / t (/ p) and the model's fit statistics."""
    return summarise(model_grams(df, {model: cols}, target, groups), groups, with_p)


def summarise(grams: DataFrame, groups: list[str], with_p: bool = True) -> DataFrame:
    """The rows of ``ols_summary`` for every (group, model) Gram row."""
    j = ols_long(grams, groups)
    extra = []
    if with_p:
        extra = [_round(F.expr(t_p_sql("t", "df_resid"))).alias("p"),
                 _round(F.expr(f_p_sql("F", "k", "df_resid"))).alias("F_p")]
    return j.select(
        *groups, "model", "term",
        _round(F.col("coef")).alias("coef"), _round(F.col("se")).alias("se"), _round(F.col("t")).alias("t"),
        "n", "k", "df_resid",
        _round(F.col("r2")).alias("r2"), _round(F.col("adj_r2")).alias("adj_r2"), _round(F.col("F")).alias("F"),
        *extra,
    )


def coefficients(df: DataFrame, cols: list[str], target: str, groups: list[str], model: str = "ols") -> DataFrame:
    """Intercept and coefficients only (wide: one row per group)."""
    coef, _ = ols_tables(model_grams(df, {model: cols}, target, groups), groups)
    return coef.groupBy(*groups, "model").pivot("term", ["const", *cols]).agg(F.first(_round(F.col("coef"))))


# --------------------------------------------------------------------------
# Scans
# --------------------------------------------------------------------------

def single_feature_scan(df: DataFrame, features: list[str], target: str, groups: list[str]) -> DataFrame:
    """Per feature: n, R², adjusted R², slope and its t (own complete cases), via regr_*.

    Carries the unrounded t as ``_t`` for ``with_slope_p``; use ``scan_result`` to drop it.
    """
    return _single_feature_scan(df, features, target, groups)


def scan_result(scan: DataFrame) -> DataFrame:
    return scan.drop("_t")


def _single_feature_scan(df: DataFrame, features: list[str], target: str, groups: list[str]) -> DataFrame:
    """Per feature: n, R², adjusted R², slope and its t (own complete cases), from shared pairwise moments."""
    m = pair_moments(df, list(dict.fromkeys([*features, target])), groups, with_=target)
    long = m.where(F.col("x").isin(features)).withColumnRenamed("x", "feature")
    fits = F.col("sxx") > 0
    long = long.withColumn("slope", F.when(fits, F.try_divide("sxy", "sxx"))).withColumn(
        "r2", F.when(fits, F.when(F.col("syy") == 0, F.lit(1.0)).otherwise(F.col("sxy") * F.try_divide("sxy", F.col("sxx") * F.col("syy")))))
    n = F.col("n")
    sse = F.col("syy") - F.col("slope") * F.col("sxy")
    se = F.sqrt(F.try_divide(F.try_divide(sse, n - 2), F.col("sxx")))
    t = F.try_divide(F.col("slope"), se)
    adj = F.when(n - 2 > 0, 1 - (1 - F.col("r2")) * (n - 1) / (n - 2))
    return long.select(
        *groups, "feature", "n",
        _round(F.col("r2")).alias("r2"), _round(adj).alias("adj_r2"),
        _round(F.col("slope")).alias("slope"), _round(t).alias("t"), t.alias("_t"),
    )


def with_slope_p(scan: DataFrame) -> DataFrame:
    """Add the slope's two-sided p (from the unrounded t, n - 2 df)."""
    return scan.withColumn("p", _round(F.expr(t_p_sql("_t", "(n - 2)")))).drop("_t")


def stepwise_scan(df: DataFrame, selected: list[str], remaining: list[str], target: str, groups: list[str],
                  with_p: bool = True) -> DataFrame:
    """Add each remaining candidate to ``selected``: R², adj R², t (and p) of the added term."""
    models = {f: [*selected, f] for f in remaining}
    j = ols_long(model_moments(df, models, target, groups), groups).filter(F.col("term") == F.col("model"))
    extra = [_round(F.expr(t_p_sql("t", "df_resid"))).alias("p")] if with_p else []
    return j.select(
        *groups, F.col("model").alias("added"), "n", "k", "df_resid",
        _round(F.col("r2")).alias("r2"), _round(F.col("adj_r2")).alias("adj_r2"),
        _round(F.col("t")).alias("t"), *extra,
    )


# --------------------------------------------------------------------------
# 3. LOOCV by PRESS
# --------------------------------------------------------------------------

PARAM_SCHEMA = ("model string, idx array<int>, beta array<double>, mu array<double>, sinv array<double>, "
                "gram array<double>, shift array<double>, n long, p int, mse double")


def _params_small(grams: DataFrame, groups: list[str], all_cols: list[str]) -> DataFrame:
    """JVM closed form of ``_params`` for models with at most one feature.

    Same semantics as the pseudo-inverse solve: a zero centred Sxx gives a
    zero slope (minimum norm)."""
    pos = F.create_map(*[x for i, cname in enumerate(all_cols) for x in (F.lit(cname), F.lit(i + 1))])
    g = F.col("gram")
    k = F.size("terms")
    n = F.col("n").cast("double")
    # gram layout: k = 0 -> [11, 1y, yy]; k = 1 -> [11, 1x, 1y, xx, xy, yy]
    sx, sy = F.when(k == 1, g[1]).otherwise(F.lit(0.0)), F.when(k == 1, g[2]).otherwise(g[1])
    sxx_raw, sxy_raw = g[3], g[4]
    syy_raw = F.when(k == 1, g[5]).otherwise(g[2])
    mu, ybar = sx / n, sy / n
    sxx = sxx_raw - n * mu * mu
    sxy = sxy_raw - n * mu * ybar
    syy = syy_raw - n * ybar * ybar
    c = F.col("shift")
    live = sxx > F.lit(1e-24) * (sxx_raw + n * c[0] * c[0])  # spread beside the column's own level
    slope = F.when(live, sxy / sxx).otherwise(F.lit(0.0))
    sinv = F.when(live, F.lit(1.0) / sxx).otherwise(F.lit(0.0))
    mu, ybar = mu + c[0], ybar + F.when(k == 1, c[1]).otherwise(c[0])
    sse = F.greatest(F.lit(0.0), F.when(k == 1, syy - slope * sxy).otherwise(syy))
    one = k == 1
    used = F.when(one & live, 1).otherwise(0)  # rank without the constant
    dfr = F.col("n") - (used + 1)
    return grams.filter(F.col("n") > 0).select(
        *groups, "model",
        F.when(one, F.array(F.lit(0), pos[F.col("terms")[0]])).otherwise(F.array(F.lit(0))).alias("idx"),
        F.when(one, F.array(ybar - mu * slope, slope)).otherwise(F.array(ybar)).alias("beta"),
        F.when(one, F.array(mu)).otherwise(F.array().cast("array<double>")).alias("mu"),
        F.when(one, F.array(sinv)).otherwise(F.array().cast("array<double>")).alias("sinv"),
        "gram", "shift", F.col("n").cast("long").alias("n"), (used + 1).alias("p"),
        F.when(dfr > 0, sse / dfr).alias("mse"),
    )


def _params(grams: DataFrame, groups: list[str], all_cols: list[str], max_k: int | None = None) -> DataFrame:
    """Coefficients and (XᵀX)⁻¹ per (group, model); ``idx`` indexes [1, all_cols...].

    Models with at most one feature are solved by JVM expressions; larger
    systems go through one Arrow-batched Python solve per (group, model)."""
    if max_k is not None and max_k <= 1:
        return _params_small(grams, groups, all_cols)
    gfields = [grams.schema[g] for g in groups]
    schema = T.StructType(gfields + T._parse_datatype_string(PARAM_SCHEMA).fields)
    pos = {cname: i + 1 for i, cname in enumerate(all_cols)}

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rec, key in _rows_of(pdf, groups):
                terms = list(rec["terms"])
                s = _solve(rec["gram"], rec["n"], len(terms), rec["shift"])
                if s["beta"] is None:
                    continue
                rows.append({**key, "model": rec["model"], "idx": [0] + [pos[t] for t in terms], **_param_fields(s),
                             "gram": [float(v) for v in rec["gram"]], "shift": [float(v) for v in rec["shift"]]})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    return grams.mapInPandas(run, schema)


def _param_fields(s: dict) -> dict:
    return {"beta": [float(b) for b in s["beta"]], "mu": [float(v) for v in s["mu"]],
            "sinv": [float(v) for v in np.asarray(s["sinv"]).ravel()], "n": s["n"], "p": s["k"] + 1,
            "mse": s["mse"]}


_LEVERAGE_ONE = 1e-9


def _exact_loo_value(x, y: float, gram, shift) -> float | None:
    """Held-out residual of one row by refitting without it: the Gram matrix is
    downdated by the row and the centred system solved with a pseudo-inverse
    (the minimum-norm least-squares fit, as a refit would give)."""
    x, shift = np.array(x, dtype=float), np.asarray(shift, dtype=float)  # [1, features...]
    k = len(x) - 1
    x[1:] -= shift[:k]
    y = y - shift[k]
    a = _sym(np.asarray(gram, dtype=float), k + 2)
    xtx = a[: k + 1, : k + 1] - np.outer(x, x)
    xty = a[: k + 1, k + 1] - x * y
    n = xtx[0, 0]
    if n <= 0:
        return None
    mu = xtx[0, 1:] / n
    ybar = xty[0] / n
    sxx = xtx[1:, 1:] - n * np.outer(mu, mu)
    sxy = xty[1:] - n * mu * ybar
    b = _pinv(sxx, xtx[1:, 1:], shift[:k], n)[0] @ sxy if k > 0 else np.zeros(0)
    return float(y - (ybar + (x[1:] - mu) @ b))


def _fill_exact_loo(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pass rows through; where PRESS is 0/0 (leverage 1) compute the exact held-out residual."""
    for pdf in it:
        e = pdf["e_press"].astype("float64").to_numpy(copy=True)
        missing = np.flatnonzero(pd.isna(pdf["e_press"]).to_numpy())
        for i in missing:
            v = _exact_loo_value(pdf["_x"].iloc[i], float(pdf["_y"].iloc[i]), pdf["gram"].iloc[i], pdf["shift"].iloc[i])
            e[i] = np.nan if v is None else v
        yield pdf.assign(e_loo=e)


def with_exact_loo(j: DataFrame) -> DataFrame:
    """Add ``e_loo``: PRESS where defined, exact refit for leverage-1 rows (at most p per group and model).

    Only the rows without a PRESS residual go through Python."""
    j = j.drop("_xall")
    schema = T.StructType([*j.schema.fields, T.StructField("e_loo", T.DoubleType(), True)])
    known = j.filter(F.col("e_press").isNotNull()).withColumn("e_loo", F.col("e_press"))
    return known.unionByName(j.filter(F.col("e_press").isNull()).mapInPandas(_fill_exact_loo, schema))


def press_rows(rows: DataFrame, params: DataFrame, target: str, all_cols: list[str], groups: list[str],
               keep: list[str] | None = None) -> DataFrame:
    """Per (row, model): residual, leverage, held-out (LOOCV) residual and Cook's D inputs."""
    keep = keep or []
    xall = F.array(F.lit(1.0), *[F.col(cname).cast("double") for cname in all_cols])
    r = rows.select(*groups, *keep, xall.alias("_xall"), F.col(target).cast("double").alias("_y"))
    j = join_groups(r, params, groups)
    j = j.withColumn("_x", F.expr("transform(idx, i -> element_at(_xall, i + 1))"))
    j = j.filter(F.col("_y").isNotNull() & F.expr("NOT exists(_x, v -> v IS NULL)"))
    j = j.withColumn("_k", F.size("mu"))
    j = j.withColumn("fitted", F.expr("aggregate(zip_with(_x, beta, (a, b) -> a * b), 0D, (acc, v) -> acc + v)"))
    # h = 1/n + (x - mu)' Sxx^-1 (x - mu), x without the leading 1
    j = j.withColumn("_c", F.expr("transform(mu, (m, i) -> _x[i + 1] - m)"))
    j = j.withColumn("h", F.lit(1.0) / F.col("n") + F.expr(
        "IF(_k = 0, 0D, aggregate(sequence(0, _k - 1), 0D, (acc, i) -> acc + _c[i] * "
        "aggregate(sequence(0, _k - 1), 0D, (acc2, l) -> acc2 + sinv[i * _k + l] * _c[l])))"
    ))
    j = j.withColumn("resid", F.col("_y") - F.col("fitted"))
    j = j.withColumn("e_press", F.when(1 - F.col("h") > _LEVERAGE_ONE, F.col("resid") / (1 - F.col("h"))))
    j = j.withColumn("cooks_d", F.try_divide(
        F.col("resid") ** 2 * F.col("h"), F.col("p") * F.col("mse") * (1 - F.col("h")) ** 2))
    return j


@single_series
def loocv_residuals(rows: DataFrame, models: dict[str, list[str]], target: str, groups: list[str],
                    keep: list[str] | None = None) -> DataFrame:
    """Per (group, model, row): fitted, residual, leverage and LOOCV residual (actual - held-out prediction)."""
    all_cols = sorted({cname for cols in models.values() for cname in cols})
    grams = model_grams(rows, models, target, groups)
    max_k = max(len(c) for c in models.values())
    params = _params(grams, groups, all_cols, max_k=max_k)
    j = press_rows(rows, params, target, all_cols, groups, keep)
    if max_k <= 1:
        # With at most one feature a leverage-1 row is the only row with its x
        # value, so the refit without it has slope 0 (minimum norm) and predicts
        # the mean of the other rows.
        about = F.when(F.size("mu") == 1, F.col("shift")[1]).otherwise(F.col("shift")[0])
        sum_y = F.when(F.size("mu") == 1, F.col("gram")[2]).otherwise(F.col("gram")[1]) + F.col("n") * about
        others = F.when(F.col("n") > 1, F.col("_y") - (sum_y - F.col("_y")) / (F.col("n") - 1))
        return j.drop("_xall").withColumn("e_loo", F.coalesce(F.col("e_press"), others))
    return with_exact_loo(j)


@single_series
def loocv_rmse(rows: DataFrame, models: dict[str, list[str]], target: str, groups: list[str]) -> DataFrame:
    """LOOCV RMSE per (group, model), equal to refitting n times."""
    r = loocv_residuals(rows, models, target, groups)
    return r.groupBy(*groups, "model").agg(
        F.count(F.lit(1)).alias("n"),
        _round(F.sqrt(F.avg(F.col("e_loo") * F.col("e_loo")))).alias("rmse"),
    )


# --------------------------------------------------------------------------
# 4. Forward selection
# --------------------------------------------------------------------------

def _materialize(df: DataFrame, checkpoint: bool = True, keys: list[str] | None = None) -> DataFrame:
    """Cut lineage with a written table in the shared checkpoint folder.

    With ``checkpoint=False`` the frame is returned as is (lazy). The write
    goes through adaptive execution (a persisted plan would not), so a small
    step table lands in few partitions and a large one is spread by ``keys``.
    """
    if not checkpoint:
        return df
    from prepcast.session import written_table

    return written_table(df, "selection", keys)


@single_series
def forward_selection(df: DataFrame, target: str, candidates: list[str], groups: list[str],
                      base_features: list[str] | None = None, max_features: int = 5, margin: float = 0.0,
                      checkpoint: bool = True) -> tuple[DataFrame, DataFrame]:
    """LOOCV forward selection per group on the common complete-case sample.

    Inside a step a candidate replaces the running best only when its RMSE is
    below ``best - margin`` (candidate order matters, as in the reference).
    Returns (trace: one row per group/step/candidate, result: one row per group).

    The common sample and, per step, the folded state (one row per group,
    carrying that step's scored candidate list for the trace) are
    checkpointed: each step's plan is a scan of checkpoint files plus one
    scoring pass, and no cached plan lingers in the session.
    """
    base_features = list(base_features or [])
    cols = [*base_features, *candidates]
    sample = _materialize(df.select(*groups, target, *cols).dropna(subset=[target, *cols]), checkpoint, groups)
    order = {cname: i for i, cname in enumerate(candidates)}
    gram_all = model_grams(sample, {"__all__": cols}, target, groups).select(*groups, F.col("gram").alias("gall"), F.col("shift").alias("sall"), "n")

    # step 0: the starting model (constant only, or the base features)
    start_models = sample.select(*groups).distinct().select(
        *groups, F.lit("__start__").alias("model"), F.lit(None).cast("string").alias("candidate"),
        F.array(*[F.lit(b) for b in base_features]).cast("array<string>").alias("terms"),
    )

    def fold(models: DataFrame, state: DataFrame | None) -> DataFrame:
        """Score the step's models and fold them into the next state: one written frame, one action."""
        scored = _score_models(sample, gram_all, models, target, cols, groups)
        return _materialize(_fold_step(scored, state, groups, margin, order), checkpoint, groups)

    start = fold(start_models, None)
    state = start.select(
        *groups, F.array(*[F.lit(b) for b in base_features]).cast("array<string>").alias("selected"), "current", "active")
    trace_parts = [start.select(*groups, F.lit(0).alias("step"), F.lit(None).cast("string").alias("candidate"),
                                _round(F.col("current")).alias("rmse"), F.lit(True).alias("chosen"))]
    steps = min(max_features - len(base_features), len(candidates))
    for step in range(1, steps + 1):
        folded = fold(_step_models(state, candidates, groups), state)
        trace_parts.append(
            folded.select(*groups, "pick", F.explode("_c").alias("_e")).select(
                *groups, F.lit(step).alias("step"), F.col("_e.candidate").alias("candidate"), _round(F.col("_e.rmse")).alias("rmse"),
                (F.col("_e.candidate") == F.col("pick")).alias("chosen"),
            )
        )
        state = folded.select(
            *groups,
            F.when(F.col("pick").isNotNull(), F.concat("selected", F.array("pick"))).otherwise(F.col("selected")).alias("selected"),
            F.when(F.col("pick").isNotNull(), F.col("best")).otherwise(F.col("current")).alias("current"),
            (F.col("active") & F.col("pick").isNotNull()).alias("active"),
        )
    trace = trace_parts[0]
    for part in trace_parts[1:]:
        trace = trace.unionByName(part)
    result = state.select(*groups, "selected", _round(F.col("current")).alias("rmse"))
    return trace, result


def _step_models(state: DataFrame, candidates: list[str], groups: list[str]) -> DataFrame:
    """(group, model id, candidate, terms) for every candidate not yet selected, active groups only."""
    cand = F.array(*[F.lit(cname) for cname in candidates])
    s = state.filter("active").select(*groups, "selected", F.explode(cand).alias("candidate"))
    s = s.filter(~F.array_contains("selected", F.col("candidate")))
    return s.select(*groups, F.col("candidate").alias("model"), "candidate",
                    F.concat("selected", F.array("candidate")).alias("terms"))


def _score_models(sample: DataFrame, gram_all: DataFrame, models: DataFrame, target: str, cols: list[str],
                  groups: list[str]) -> DataFrame:
    """Unrounded LOOCV RMSE of each (group, model) whose terms differ per group (lazy).

    Sub-systems of the group's Gram matrix (over all columns) are solved per
    model, then one PRESS pass scores them all. Rows with leverage 1 (PRESS
    undefined; at most one per unknown) travel in a list beside their model's
    sums and are refitted there, so no group is scored twice.
    """
    m = models.join(gram_all, groups)
    full = ["const", *cols, "__y__"]
    pos = {name: i for i, name in enumerate(full)}
    size = len(full)
    gfields = [m.schema[g] for g in groups]
    schema = T.StructType(gfields + T._parse_datatype_string(PARAM_SCHEMA).fields)

    def run(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            rows = []
            for rec in pdf.to_dict("records"):
                key = {g: rec[g] for g in groups}
                big = _sym(np.asarray(rec["gall"], dtype=float), size)
                sel = [0] + [pos[t] for t in rec["terms"]] + [pos["__y__"]]
                sub = big[np.ix_(sel, sel)]
                k = len(sel) - 2
                gram = [sub[i, j] for i, j in _tri_index(k + 2)]
                shift = [float(rec["sall"][i - 1]) for i in sel[1:]]
                s = _solve(gram, rec["n"], k, shift)
                if s["beta"] is None:
                    continue
                rows.append({**key, "model": rec["model"], "idx": sel[:-1], **_param_fields(s),
                             "gram": [float(v) for v in gram], "shift": shift})
            yield pd.DataFrame(rows, columns=[f.name for f in schema.fields])

    params = m.select(*groups, "model", "terms", "gall", "sall", "n").mapInPandas(run, schema)
    j = press_rows(sample, params, target, cols, groups)
    names = models.select(*groups, "model", "candidate")
    sums = j.groupBy(*groups, "model").agg(
        F.sum(F.col("e_press") * F.col("e_press")).alias("_ss"), F.count(F.lit(1)).alias("_n"),
        F.collect_list(F.when(F.col("e_press").isNull(), F.struct("_x", "_y"))).alias("_lev1"),
        F.first("gram").alias("gram"), F.first("shift").alias("shift"),
    )

    def refit(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            extra = [sum((_exact_loo_value(r["_x"], r["_y"], g, c) or 0.0) ** 2 for r in lev)
                     for lev, g, c in zip(pdf["_lev1"], pdf["gram"], pdf["shift"])]
            rmse = np.sqrt((pdf["_ss"].fillna(0.0) + extra) / pdf["_n"])
            yield pdf[[*groups, "model"]].assign(rmse=rmse)

    out = sums.mapInPandas(refit, T.StructType(gfields + T._parse_datatype_string("model string, rmse double").fields))
    return out.join(names, [*groups, "model"])


def _fold_step(scored: DataFrame, state: DataFrame | None, groups: list[str], margin: float,
               order: dict[str, int]) -> DataFrame:
    """Running-best fold over each group's candidates in list order.

    Output per group: selected, current, active, best, pick, the scored
    candidate list ``_c`` (for the trace). With ``state=None`` (the starting model) the score itself becomes
    the current RMSE.
    """
    if state is None:
        return scored.select(
            *groups, F.array().cast("array<string>").alias("selected"), F.col("rmse").alias("current"),
            F.lit(True).alias("active"), F.col("rmse").alias("best"), F.lit(None).cast("string").alias("pick"),
            F.array().cast("array<struct<_ord:int,candidate:string,rmse:double>>").alias("_c"),
        )
    ordmap = F.create_map(*[x for cname, i in order.items() for x in (F.lit(cname), F.lit(i))])
    s = scored.withColumn("_ord", ordmap[F.col("candidate")])
    lists = s.groupBy(*groups).agg(
        F.array_sort(F.collect_list(F.struct("_ord", "candidate", "rmse"))).alias("_c"))
    j = state.filter("active").join(lists, groups, "left")
    fold = F.aggregate(
        "_c",
        F.struct(F.col("current").alias("best"), F.lit(None).cast("string").alias("pick")),
        lambda acc, x: F.when(x["rmse"] < acc["best"] - F.lit(float(margin)),
                              F.struct(x["rmse"].alias("best"), x["candidate"].alias("pick"))).otherwise(acc),
    )
    j = j.withColumn("_f", fold)
    inactive = state.filter(~F.col("active")).select(
        *groups, "selected", "current", "active", F.lit(None).cast("double").alias("best"),
        F.lit(None).cast("string").alias("pick"),
        F.array().cast("array<struct<_ord:int,candidate:string,rmse:double>>").alias("_c"))
    return j.select(*groups, "selected", "current", "active", F.col("_f.best").alias("best"),
                    F.col("_f.pick").alias("pick"), "_c").unionByName(inactive)


# --------------------------------------------------------------------------
# Prediction and standardisation
# --------------------------------------------------------------------------

def predict(df: DataFrame, coef: DataFrame, groups: list[str], model: str, terms: list[str]) -> DataFrame:
    """Apply a stored coefficient table (group, model, term, coef) to rows.

    The table has one row per group and term, so the per-group map is tiny;
    the join is on the group key (Spark picks broadcast when it is small).
    """
    c = coef.filter(F.col("model") == model)
    wide = c.groupBy(*groups).agg(F.map_from_entries(F.collect_list(F.struct("term", "coef"))).alias("_b"))
    j = df.join(wide, groups, "left") if groups else join_groups(df, wide, groups)
    pred = F.coalesce(F.col("_b")["const"], F.lit(0.0))
    for t in terms:
        pred = pred + F.coalesce(F.col("_b")[t], F.lit(0.0)) * F.col(t).cast("double")
    return j.withColumn("prediction", pred).drop("_b")


def standardize(df: DataFrame, cols: list[str], groups: list[str]) -> DataFrame:
    """(x - mean) / population sd per group, fitted on all non-null values."""
    stats = df.groupBy(*groups).agg(*[
        e for cname in cols for e in (F.avg(cname).alias(f"_mu_{cname}"), F.stddev_pop(cname).alias(f"_sd_{cname}"))
    ])
    j = df.join(stats, groups, "left") if groups else join_groups(df, stats, groups)
    for cname in cols:
        j = j.withColumn(cname, F.try_divide(F.col(cname) - F.col(f"_mu_{cname}"), F.col(f"_sd_{cname}")))
    return j.drop(*[f"_{p}_{cname}" for cname in cols for p in ("mu", "sd")])
