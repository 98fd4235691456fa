"""Correlation, regression, influence and back-test queries (§2.12-2.14).

The analysis frame is the feature table with weekday dummies, per store.
One-feature and two-feature results are checked against DuckDB through
closed forms (regr_* aggregates, Cramer's rule); the rest are rows-only.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from prepcast.operators import backtest, corr, gram_store, influence, regression
from prepcast.operators.features import FEATURE_COLUMNS
from prepcast.plans import tables as T
from prepcast.plans.catalog import register
from prepcast.plans.forward_sql import forward_ctes
from prepcast.plans.oracle_sql import F_P, FEATURE_CTES, T_P, R, sql
from prepcast.session import scratch_path

STORE = ["store_id"]
T1, T2 = "cumul_16_19", "cumul_20_22"

# Fixed column lists of the reference's analyses (weekday dummies 화/금 -> dow_tue/dow_fri).
TIME_COLS = [T1, T2, *FEATURE_COLUMNS]
CORR_COLS = [
    "cumul_16_19", "cumul_20_22", "before_rest",
    "lag_prev_day_t1", "lag_prev_day_t2", "lag_same_day_t1", "lag_same_day_t2",
    "lag_biweekly_t1", "lag_biweekly_t2",
    "roll_prev_3days_mean_t1", "roll_prev_3days_mean_t2",
    "roll_same_3days_mean_t1", "roll_same_3days_mean_t2",
    "roll_prev_5days_mean_t1", "roll_prev_5days_mean_t2", "dow_tue", "dow_fri",
]
CANDIDATES_T1 = [
    "before_rest", "lag_prev_day_t1", "lag_prev_day_t2", "lag_same_day_t1", "lag_same_day_t2",
    "lag_biweekly_t1", "lag_biweekly_t2",
    "roll_prev_3days_mean_t1", "roll_prev_3days_mean_t2",
    "roll_prev_5days_mean_t1", "roll_prev_5days_mean_t2", "dow_tue", "dow_fri",
]
CANDIDATES_T2 = ["cumul_16_19", *CANDIDATES_T1]
T2_MODEL = ["dow_fri", "roll_prev_3days_mean_t2"]
OUTLIER_DATES = ["2024-01-08", "2024-01-09"]  # declared outlier days of the with/without comparison
TRAIN_END = "2024-01-22"  # model training uses earlier days; later days are the back-test
DIAG_FEATURE, DIAG_TARGET = "lag_same_day_t1", "cumul_16_19"
SNAPSHOT_END = "2024-01-22"  # 'before' snapshot of the before/after diagnosis


def af(spark, sf):
    """Analysis frame: features + dummies."""
    return T.af(spark, sf)


AF = """
af AS (
    SELECT *, CASE WHEN day_of_week = '화' THEN 1 ELSE 0 END AS dow_tue,
              CASE WHEN day_of_week = '금' THEN 1 ELSE 0 END AS dow_fri
    FROM mf
)"""
AF_CTES = (*FEATURE_CTES, AF)


def r4(x: str) -> str:
    return R(x, 4)


def r6(x: str) -> str:
    return R(x, 6)


def _pearson_sql(y: str, x: str) -> str:
    return (f"round(regr_sxy({y}, {x}) / NULLIF(sqrt(regr_sxx({y}, {x}) * regr_syy({y}, {x})), 0), 6)")


# ----------------------------------------------------------------- correlation

_UNPIVOT = f"""
afd AS (SELECT store_id, day_id, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CORR_COLS)} FROM af),
u AS (
    SELECT * FROM afd UNPIVOT INCLUDE NULLS (val FOR var IN ({', '.join(CORR_COLS)}))
)"""


@register("cor_matrix", sql((*AF_CTES, _UNPIVOT), f"""
SELECT a.store_id, a.var AS x, b.var AS y, {_pearson_sql('a.val', 'b.val')} AS r,
       CAST(regr_count(a.val, b.val) AS BIGINT) AS n
FROM u a JOIN u b ON a.store_id = b.store_id AND a.day_id = b.day_id
GROUP BY a.store_id, a.var, b.var"""))
def cor_matrix(spark, sf):
    return corr.corr_matrix(af(spark, sf), CORR_COLS, STORE)


def _segmented(df):
    seg = F.array(F.lit("all"), F.when(F.col("dow_tue") == 1, F.lit("tue")).otherwise(F.lit("mon_fri")))
    return df.withColumn("segment", F.explode(seg))


_SEG = """
seg AS (
    SELECT *, 'all' AS segment FROM af
    UNION ALL
    SELECT *, CASE WHEN dow_tue = 1 THEN 'tue' ELSE 'mon_fri' END FROM af
)"""


def _target_sql(src: str, target: str, group: str) -> str:
    parts = [
        f"SELECT {group}, '{c}' AS feature, {i} AS pos, {_pearson_sql(target, c)} AS r FROM {src} GROUP BY {group}"
        for i, c in enumerate(TIME_COLS)
    ]
    return "\nUNION ALL\n".join(parts)


@register("cor_target", sql((*AF_CTES, _SEG), _target_sql("seg", T1, "store_id, segment")))
def cor_target(spark, sf):
    return corr.corr_target(_segmented(af(spark, sf)), TIME_COLS, T1, [*STORE, "segment"])


@register("ord_corr_desc", sql((*AF_CTES, _SEG), "SELECT * FROM (" + _target_sql("seg", T2, "store_id, segment")
                                + ") t ORDER BY store_id, segment, r DESC NULLS LAST"))
def ord_corr_desc(spark, sf):
    ct = corr.corr_target(_segmented(af(spark, sf)), TIME_COLS, T2, [*STORE, "segment"])
    return corr.sorted_desc(ct, [*STORE, "segment"])


_EXCL = ", ".join(f"DATE '{d}'" for d in OUTLIER_DATES)


@register("cor_with_without", sql(AF_CTES, "\nUNION ALL\n".join(
    f"SELECT store_id, '{c}' AS feature, {i} AS pos, {_pearson_sql(T1, c)} AS r_incl, "
    f"{_pearson_sql(f'CASE WHEN date NOT IN ({_EXCL}) OR date IS NULL THEN {T1} END', f'CASE WHEN date NOT IN ({_EXCL}) OR date IS NULL THEN {c} END')} AS r_excl "
    f"FROM af GROUP BY store_id"
    for i, c in enumerate(TIME_COLS)
)))
def cor_with_without(spark, sf):
    return corr.corr_with_without(af(spark, sf), TIME_COLS, T1, STORE, OUTLIER_DATES)


@register("cor_select", sql(AF_CTES, "SELECT * FROM (" + _target_sql("af", T1, "store_id")
                             + f") t WHERE abs(r) > 0.3 AND feature <> '{T1}'"))
def cor_select(spark, sf):
    return corr.select_candidates(af(spark, sf), TIME_COLS, T1, STORE, 0.3)


# ----------------------------------------------------------------- regression

def _scan_sql(target: str, feats: list[str], with_p: bool = False) -> str:
    parts = []
    for f in feats:
        n = f"regr_count({target}, {f})"
        slope = f"(CASE WHEN regr_sxx({target}, {f}) = 0 THEN NULL ELSE regr_slope({target}, {f}) END)"
        sse = f"(regr_syy({target}, {f}) - {slope} * regr_sxy({target}, {f}))"
        t = f"{slope} / NULLIF(sqrt(({sse} / NULLIF({n} - 2, 0)) / NULLIF(regr_sxx({target}, {f}), 0)), 0)"
        parts.append(
            f"SELECT store_id, '{f}' AS feature, CAST({n} AS BIGINT) AS n, {r4(f'regr_r2({target}, {f})')} AS r2, "
            f"{r4(f'CASE WHEN {n} - 2 > 0 THEN 1 - (1 - regr_r2({target}, {f})) * ({n} - 1) / ({n} - 2) END')} AS adj_r2, "
            f"{r4(slope)} AS slope, {r4(t)} AS t"
            + (f", {r4(T_P(t, f'({n} - 2)'))} AS p" if with_p else "")
            + " FROM af GROUP BY store_id"
        )
    return "\nUNION ALL\n".join(parts)


@register("reg_single_scan", sql(AF_CTES, _scan_sql(T1, FEATURE_COLUMNS)))
def reg_single_scan(spark, sf):
    return regression.scan_result(regression.single_feature_scan(af(spark, sf), FEATURE_COLUMNS, T1, STORE))


@register("reg_single_scan_pvalue", sql(AF_CTES, _scan_sql(T1, FEATURE_COLUMNS, with_p=True)))
def reg_single_scan_pvalue(spark, sf):
    return regression.with_slope_p(regression.single_feature_scan(af(spark, sf), FEATURE_COLUMNS, T1, STORE))


def _ols2(src: str, y: str, x1: str, x2: str, where: str = "TRUE", name: str = "o2", grp: str = "store_id") -> str:
    """Two-regressor OLS per group in closed form: coefficients, standard errors and fit."""
    return f"""
{name}_cc AS (SELECT {grp}, CAST({x1} AS DOUBLE) AS x1, CAST({x2} AS DOUBLE) AS x2, CAST({y} AS DOUBLE) AS y FROM {src}
       WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL AND {where}),
{name}_m AS (
    SELECT {grp}, COUNT(*) AS n, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my,
           VAR_POP(x1) * COUNT(*) AS s11, VAR_POP(x2) * COUNT(*) AS s22, COVAR_POP(x1, x2) * COUNT(*) AS s12,
           COVAR_POP(x1, y) * COUNT(*) AS s1y, COVAR_POP(x2, y) * COUNT(*) AS s2y, VAR_POP(y) * COUNT(*) AS syy
    FROM {name}_cc GROUP BY {grp}
),
{name}_b AS (
    SELECT *, s11 * s22 - s12 * s12 AS det,
           (s22 * s1y - s12 * s2y) / NULLIF(s11 * s22 - s12 * s12, 0) AS b1,
           (s11 * s2y - s12 * s1y) / NULLIF(s11 * s22 - s12 * s12, 0) AS b2
    FROM {name}_m
),
{name}_f AS (
    SELECT *, my - b1 * m1 - b2 * m2 AS b0, GREATEST(syy - b1 * s1y - b2 * s2y, 0) AS sse, n - 1 - rnk AS df_resid
    FROM (SELECT *, CASE WHEN s11 = 0 AND s22 = 0 THEN 0 WHEN s11 = 0 OR s22 = 0 OR det <= 1e-10 * s11 * s22 THEN 1 ELSE 2 END AS rnk
          FROM {name}_b) r
),
{name} AS (
    SELECT *, sse / NULLIF(df_resid, 0) AS sigma2,
           CASE WHEN syy > 0 AND df_resid <= 0 THEN 1.0 WHEN syy > 0 THEN 1 - sse / syy END AS r2,
           CASE WHEN syy > 0 AND df_resid > 0 THEN 1 - (sse / syy) * (n - 1) / df_resid END AS adj_r2,
           CASE WHEN syy > 0 AND df_resid > 0 AND sse > 0 THEN ((syy - sse) / NULLIF(rnk, 0)) / (sse / df_resid) END AS F,
           CASE WHEN df_resid > 0 THEN sqrt(sse / df_resid * (1.0 / n + (m1 * m1 * s22 - 2 * m1 * m2 * s12 + m2 * m2 * s11) / det)) END AS se0,
           CASE WHEN df_resid > 0 THEN sqrt(sse / df_resid * s22 / det) END AS se1,
           CASE WHEN df_resid > 0 THEN sqrt(sse / df_resid * s11 / det) END AS se2
    FROM {name}_f
)"""


def _ols2_long(name: str, model: str, x1: str, x2: str, with_p: bool = False) -> str:
    parts = []
    for term, b, se in (("const", "b0", "se0"), (x1, "b1", "se1"), (x2, "b2", "se2")):
        pcols = (f", {r4(T_P(f'{b} / NULLIF({se}, 0)', 'df_resid'))} AS p, {r4(F_P('F', '2', 'df_resid'))} AS F_p"
                 if with_p else "")
        parts.append(
            f"SELECT store_id, '{model}' AS model, '{term}' AS term, {r4(b)} AS coef, {r4(se)} AS se, "
            f"{r4(f'{b} / NULLIF({se}, 0)')} AS t, n, CAST(rnk AS INTEGER) AS k, df_resid, {r4('r2')} AS r2, "
            f"{r4('adj_r2')} AS adj_r2, {r4('F')} AS F{pcols} FROM {name}"
        )
    return "\nUNION ALL\n".join(parts)


_STEP_BASE = "lag_biweekly_t1"
_STEP_REMAINING = [f for f in FEATURE_COLUMNS if f != _STEP_BASE]


def _stepwise_sql(with_p: bool) -> str:
    return sql(
        (*AF_CTES, *[_ols2("af", T1, _STEP_BASE, c, name=f"s{i}") for i, c in enumerate(_STEP_REMAINING)]),
        "\nUNION ALL\n".join(
            f"SELECT store_id, '{c}' AS added, n, CAST(rnk AS INTEGER) AS k, df_resid, {r4('r2')} AS r2, {r4('adj_r2')} AS adj_r2, "
            f"{r4('b2 / NULLIF(se2, 0)')} AS t"
            + (f", {r4(T_P('b2 / NULLIF(se2, 0)', 'df_resid'))} AS p" if with_p else "")
            + f" FROM s{i}"
            for i, c in enumerate(_STEP_REMAINING)))


@register("reg_stepwise_scan", _stepwise_sql(False))
def reg_stepwise_scan(spark, sf):
    return regression.stepwise_scan(af(spark, sf), [_STEP_BASE], _STEP_REMAINING, T1, STORE, with_p=False)


@register("reg_stepwise_scan_pvalue", _stepwise_sql(True))
def reg_stepwise_scan_pvalue(spark, sf):
    return regression.stepwise_scan(af(spark, sf), [_STEP_BASE], _STEP_REMAINING, T1, STORE)


@register("reg_ols", sql((*AF_CTES, _ols2("af", T2, *T2_MODEL)), _ols2_long("o2", "t2", *T2_MODEL)))
def reg_ols(spark, sf):
    return regression.ols_summary(af(spark, sf), T2_MODEL, T2, STORE, model="t2", with_p=False)


@register("reg_ols_refreshed", sql((*AF_CTES, _ols2("af", T2, *T2_MODEL)), _ols2_long("o2", "t2", *T2_MODEL)))
def reg_ols_refreshed(spark, sf):
    """A stored Gram table of the days before ``TRAIN_END``, with the outlier days entered wrongly, after a refresh
    that takes these out, enters them anew and adds the days since: the fit of all rows."""
    models, rows, path = {"t2": T2_MODEL}, af(spark, sf), scratch_path(spark, "grams")
    wrong = F.col("date").isin(*[F.to_date(F.lit(d)) for d in OUTLIER_DATES])
    before = rows.where(F.col("date") < TRAIN_END).withColumn(T2, F.when(wrong, F.col(T2) * 2).otherwise(F.col(T2)))
    gram_store.create(path, before, models, T2, STORE)
    gram_store.refresh(path, before.where(wrong), rows.where(wrong | (F.col("date") >= TRAIN_END)), models, T2, STORE)
    return regression.summarise(gram_store.stored(spark, path), STORE, with_p=False)


@register("reg_ols_pvalue", sql((*AF_CTES, _ols2("af", T2, *T2_MODEL)), _ols2_long("o2", "t2", *T2_MODEL, with_p=True)))
def reg_ols_pvalue(spark, sf):
    return regression.ols_summary(af(spark, sf), T2_MODEL, T2, STORE, model="t2")


def _cramer(src: str, y: str, x1: str, x2: str, where: str = "TRUE") -> str:
    """Two-regressor OLS per store in closed form (centred sums, Cramer's rule)."""
    return f"""
cc AS (SELECT store_id, {x1} AS x1, {x2} AS x2, {y} AS y FROM {src}
       WHERE {y} IS NOT NULL AND {x1} IS NOT NULL AND {x2} IS NOT NULL AND {where}),
mom AS (
    SELECT store_id, COUNT(*) AS n, AVG(x1) AS m1, AVG(x2) AS m2, AVG(y) AS my,
           VAR_POP(x1) AS s11, VAR_POP(x2) AS s22, COVAR_POP(x1, x2) AS s12,
           COVAR_POP(x1, y) AS s1y, COVAR_POP(x2, y) AS s2y
    FROM cc GROUP BY store_id
),
coef AS (
    SELECT store_id, n, my,
           (s22 * s1y - s12 * s2y) / NULLIF(s11 * s22 - s12 * s12, 0) AS b1,
           (s11 * s2y - s12 * s1y) / NULLIF(s11 * s22 - s12 * s12, 0) AS b2, m1, m2
    FROM mom
),
coef2 AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0 FROM coef)"""


@register("reg_coefficients", sql((*AF_CTES, _cramer("af", T2, *T2_MODEL)), f"""
SELECT store_id, 't2' AS model, {r4('b0')} AS const, {r4('b1')} AS {T2_MODEL[0]}, {r4('b2')} AS {T2_MODEL[1]} FROM coef2"""))
def reg_coefficients(spark, sf):
    c = regression.coefficients(af(spark, sf), T2_MODEL, T2, STORE, model="t2")
    return c.select(*STORE, "model", *[F.round(F.col(x), 4).alias(x) for x in ["const", *T2_MODEL]])


_STD = """
std AS (
    SELECT * REPLACE ((roll_prev_3days_mean_t2 - AVG(roll_prev_3days_mean_t2) OVER (PARTITION BY store_id))
                      / NULLIF(STDDEV_POP(roll_prev_3days_mean_t2) OVER (PARTITION BY store_id), 0) AS roll_prev_3days_mean_t2)
    FROM af
)"""


@register("reg_standardized", sql((*AF_CTES, _STD, _ols2("std", T2, *T2_MODEL)), _ols2_long("o2", "t2_std", *T2_MODEL)))
def reg_standardized(spark, sf):
    scaled = regression.standardize(af(spark, sf), ["roll_prev_3days_mean_t2"], STORE)
    return regression.ols_summary(scaled, T2_MODEL, T2, STORE, model="t2_std", with_p=False)


@register("reg_standardized_pvalue", sql((*AF_CTES, _STD, _ols2("std", T2, *T2_MODEL)),
                                         _ols2_long("o2", "t2_std", *T2_MODEL, with_p=True)))
def reg_standardized_pvalue(spark, sf):
    scaled = regression.standardize(af(spark, sf), ["roll_prev_3days_mean_t2"], STORE)
    return regression.ols_summary(scaled, T2_MODEL, T2, STORE, model="t2_std")


@register("prj_standardize", sql(AF_CTES, """
SELECT store_id, day_id, round((roll_prev_3days_mean_t2 - AVG(roll_prev_3days_mean_t2) OVER (PARTITION BY store_id))
       / NULLIF(STDDEV_POP(roll_prev_3days_mean_t2) OVER (PARTITION BY store_id), 0), 6) AS roll_prev_3days_mean_t2_z
FROM af"""))
def prj_standardize(spark, sf):
    z = regression.standardize(af(spark, sf), ["roll_prev_3days_mean_t2"], STORE)
    return z.select(*STORE, "day_id", F.round("roll_prev_3days_mean_t2", 6).alias("roll_prev_3days_mean_t2_z"))


_LOO_BASE = f"""
lb AS (SELECT store_id, {T2} AS y, AVG({T2}) OVER (PARTITION BY store_id) AS my,
              COUNT({T2}) OVER (PARTITION BY store_id) AS n FROM af WHERE {T2} IS NOT NULL),
l1s AS (SELECT store_id, roll_prev_3days_mean_t2 AS x, {T2} AS y FROM af
        WHERE {T2} IS NOT NULL AND roll_prev_3days_mean_t2 IS NOT NULL),
l1f AS (SELECT store_id, COUNT(*) AS n, AVG(x) AS mx, regr_sxx(y, x) AS sxx, regr_slope(y, x) AS b,
               regr_intercept(y, x) AS a FROM l1s GROUP BY store_id),
l1 AS (SELECT s.store_id, f.n, (s.y - (f.a + f.b * s.x)) / (1 - (1.0 / f.n + (s.x - f.mx) * (s.x - f.mx) / f.sxx)) AS e
       FROM l1s s JOIN l1f f ON s.store_id = f.store_id)"""


@register("reg_loocv_rmse", sql((*AF_CTES, _LOO_BASE), f"""
SELECT store_id, 'baseline' AS model, COUNT(*) AS n, {r4('sqrt(AVG(((y - my) / (1 - 1.0 / n)) * ((y - my) / (1 - 1.0 / n))))')} AS rmse
FROM lb GROUP BY store_id
UNION ALL
SELECT store_id, 'roll_prev_3days_mean_t2', COUNT(*), {r4('sqrt(AVG(e * e))')} FROM l1 GROUP BY store_id"""))
def reg_loocv_rmse(spark, sf):
    models = {"baseline": [], "roll_prev_3days_mean_t2": ["roll_prev_3days_mean_t2"]}
    r = regression.loocv_rmse(af(spark, sf), models, T2, STORE)
    return r.withColumn("rmse", F.round("rmse", 4))


_FWD = {"max_features": 3, "margin": 50.0}
_FS1, _FS1_TRACE, _ = forward_ctes("af", T1, CANDIDATES_T1, [], **_FWD)
_FS2, _, _FS2_RESULT = forward_ctes("af", T2, CANDIDATES_T2, [], **_FWD)
_CAND_BASED = [c for c in CANDIDATES_T2 if c != "dow_fri"]
_FSB, _FSB_TRACE, _FSB_RESULT = forward_ctes("af", T2, _CAND_BASED, ["dow_fri"], 4, 0.0)


@register("reg_forward_select", sql((*AF_CTES, _FS2), _FS2_RESULT))
def reg_forward_select(spark, sf):
    """Chosen features (in order of choice, comma-joined) and LOOCV RMSE per store."""
    _, result = regression.forward_selection(af(spark, sf), T2, CANDIDATES_T2, STORE, **_FWD)
    return result.withColumn("selected", F.array_join("selected", ","))


@register("reg_forward_select_trace", sql((*AF_CTES, _FS1), _FS1_TRACE))
def reg_forward_select_trace(spark, sf):
    trace, _ = regression.forward_selection(af(spark, sf), T1, CANDIDATES_T1, STORE, **_FWD)
    return trace


def _based(spark, sf):
    return regression.forward_selection(af(spark, sf), T2, _CAND_BASED, STORE, base_features=["dow_fri"], max_features=4, margin=0.0)


@register("reg_forward_select_base", sql((*AF_CTES, _FSB), _FSB_RESULT))
def reg_forward_select_base(spark, sf):
    """The same from a fixed base feature and without a margin."""
    return _based(spark, sf)[1].withColumn("selected", F.array_join("selected", ","))


@register("reg_forward_select_base_trace", sql((*AF_CTES, _FSB), _FSB_TRACE))
def reg_forward_select_base_trace(spark, sf):
    return _based(spark, sf)[0]


# ------------------------------------------------------------- back-test

def _train_valid(spark, sf):
    a = af(spark, sf)
    train = a.filter(F.col("date") < F.lit(TRAIN_END).cast("date"))
    valid = a.filter((F.col("date") >= F.lit(TRAIN_END).cast("date")) & F.col("roll_prev_3days_mean_t2").isNotNull()
                     & F.col(T2).isNotNull())
    return train, valid


def _predictions(spark, sf):
    train, valid = _train_valid(spark, sf)
    coef, _ = regression.ols_tables(regression.model_grams(train, {"t2": T2_MODEL}, T2, STORE), STORE)
    cmean = train.dropna(subset=[T2, *T2_MODEL]).groupBy(*STORE).agg(F.round(F.avg(T2).cast("decimal(38,10)"), 4)
                                                                     .cast("double").alias("c_value"))
    p = regression.predict(valid, coef, STORE, "t2", T2_MODEL).join(cmean, STORE, "left")
    return p.select(*STORE, "day_id", "date", "day_of_week", T2, "roll_prev_3days_mean_t2",
                    F.round("prediction", 4).alias("prediction"), "c_value")


_BT = _cramer("af", T2, *T2_MODEL, where=f"date < DATE '{TRAIN_END}'") + f""",
pred AS (
    SELECT a.store_id, a.day_id, a.date, a.day_of_week, a.{T2}, a.roll_prev_3days_mean_t2,
           {r4('c.b0 + c.b1 * a.dow_fri + c.b2 * a.roll_prev_3days_mean_t2')} AS prediction, {r4('c.my')} AS c_value
    FROM af a LEFT JOIN coef2 c ON a.store_id = c.store_id
    WHERE a.date >= DATE '{TRAIN_END}' AND a.roll_prev_3days_mean_t2 IS NOT NULL AND a.{T2} IS NOT NULL
),
res AS (
    SELECT *, 8800.0 - {T2} AS A_residual, round_even(prediction - {T2}, 0) AS B_residual, c_value - {T2} AS C_residual
    FROM pred
),
win AS (
    SELECT *, abs(A_residual) AS A_abs, abs(B_residual) AS B_abs, abs(C_residual) AS C_abs,
           abs(B_residual) < abs(A_residual) AS B_beats_A, abs(B_residual) < abs(C_residual) AS B_beats_C,
           abs(B_residual) < abs(A_residual) AND abs(B_residual) < abs(C_residual) AS B_wins_both
    FROM res
)"""


@register("reg_predict", sql((*AF_CTES, _BT), "SELECT * FROM pred"))
def reg_predict(spark, sf):
    return _predictions(spark, sf)


@register("bt_residuals", sql((*AF_CTES, _BT), "SELECT * FROM res"))
def bt_residuals(spark, sf):
    return backtest.residuals(_predictions(spark, sf), T2, "prediction", "c_value", STORE)


@register("bt_wins", sql((*AF_CTES, _BT), "SELECT * FROM win"))
def bt_wins(spark, sf):
    return backtest.wins(backtest.residuals(_predictions(spark, sf), T2, "prediction", "c_value", STORE))


def _avg(x: str) -> str:
    return r4(f"AVG({x})")


@register("bt_rates", sql((*AF_CTES, _BT), f"""
SELECT store_id, COUNT(*) AS n, {_avg('CAST(B_beats_A AS INTEGER)')} AS rate_B_beats_A,
       {_avg('CAST(B_beats_C AS INTEGER)')} AS rate_B_beats_C, {_avg('CAST(B_wins_both AS INTEGER)')} AS rate_B_wins_both,
       {_avg('A_abs')} AS mae_A, {_avg('B_abs')} AS mae_B, {_avg('C_abs')} AS mae_C
FROM win GROUP BY store_id"""))
def bt_rates(spark, sf):
    return backtest.rates(bt_wins(spark, sf), STORE)


@register("bt_split_mae", sql((*AF_CTES, _BT), f"""
SELECT store_id, B_wins_both, COUNT(*) AS n, {_avg('A_abs')} AS mae_A, {_avg('B_abs')} AS mae_B, {_avg('C_abs')} AS mae_C
FROM win GROUP BY store_id, B_wins_both"""))
def bt_split_mae(spark, sf):
    return backtest.split_mae(bt_wins(spark, sf), STORE)


@register("bt_change_rate", sql((*AF_CTES, _BT), f"""
SELECT store_id, {r4('(ah - bh) / NULLIF(ah, 0) * 100')} AS success_rate, {r4('abs((am - bm) / NULLIF(am, 0) * 100)')} AS failure_rate
FROM (SELECT store_id, AVG(CASE WHEN B_wins_both THEN A_abs END) AS ah, AVG(CASE WHEN B_wins_both THEN B_abs END) AS bh,
             AVG(CASE WHEN NOT B_wins_both THEN A_abs END) AS am, AVG(CASE WHEN NOT B_wins_both THEN B_abs END) AS bm
      FROM win GROUP BY store_id) s"""))
def bt_change_rate(spark, sf):
    return backtest.change_rate(bt_wins(spark, sf), STORE)


@register("bt_gap", sql((*AF_CTES, _BT), f"SELECT store_id, day_id, roll_prev_3days_mean_t2 - {T2} AS gap FROM pred"))
def bt_gap(spark, sf):
    _, valid = _train_valid(spark, sf)
    return backtest.gap(valid, "roll_prev_3days_mean_t2", T2).select(*STORE, "day_id", "gap")


@register("prj_gap", sql(AF_CTES, f"SELECT store_id, day_id, roll_prev_3days_mean_t2 - {T2} AS gap FROM af"))
def prj_gap(spark, sf):
    return backtest.gap(af(spark, sf), "roll_prev_3days_mean_t2", T2).select(*STORE, "day_id", "gap")


# ------------------------------------------------------------- influence

def _diag(spark, sf, groups=None, frame=None):
    return influence.diagnose(frame if frame is not None else af(spark, sf), DIAG_FEATURE, DIAG_TARGET, groups or STORE)


def _diag_sql(src: str = "af", grp: str = "store_id") -> str:
    x, y = DIAG_FEATURE, DIAG_TARGET
    return f"""
sub AS (SELECT {grp}, date, {x}, {y} FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
fit AS (SELECT {grp}, COUNT(*) AS n, AVG({x}) AS mx, regr_sxx({y}, {x}) AS sxx, regr_slope({y}, {x}) AS b,
               regr_intercept({y}, {x}) AS a FROM sub GROUP BY {grp}),
res AS (SELECT s.*, f.n, s.{y} - (f.a + f.b * s.{x}) AS e,
               1.0 / f.n + (s.{x} - f.mx) * (s.{x} - f.mx) / f.sxx AS h
        FROM sub s JOIN fit f USING ({grp})),
res2 AS (SELECT *, e / (1 - h) AS loo_resid, SUM(e * e) OVER (PARTITION BY {grp}) / (n - 2) AS mse FROM res),
diag AS (SELECT *, e * e * h / (2 * mse * (1 - h) * (1 - h)) AS cooks_d, 4.0 / n AS threshold FROM res2)"""


@register("dia_loocv_resid", sql((*AF_CTES, _diag_sql()), f"SELECT store_id, date, {r4('loo_resid')} AS loo_resid FROM diag"))
def dia_loocv_resid(spark, sf):
    return influence.loocv_report(_diag(spark, sf), STORE)


@register("dia_rmse_wo_worst", sql((*AF_CTES, _diag_sql()), f"""
SELECT store_id, COUNT(*) AS n, {r4('sqrt(SUM(loo_resid * loo_resid) / COUNT(*))')} AS rmse,
       {r4('sqrt((SUM(loo_resid * loo_resid) - MAX(loo_resid * loo_resid)) / NULLIF(COUNT(*) - 1, 0))')} AS rmse_wo_worst
FROM diag GROUP BY store_id"""))
def dia_rmse_wo_worst(spark, sf):
    return influence.rmse_without_worst(_diag(spark, sf), STORE)


def _top_sql(metric: str, cols: str, grp: str = "store_id") -> str:
    return (f"SELECT {cols} FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY {grp} ORDER BY {metric} DESC, date ASC) AS rn "
            f"FROM diag) t WHERE rn = 1")


@register("dia_worst_row", sql((*AF_CTES, _diag_sql()), _top_sql(
    "abs(loo_resid)", f"store_id, date, {DIAG_FEATURE}, {DIAG_TARGET}, {r4('loo_resid')} AS loo_resid")))
def dia_worst_row(spark, sf):
    return influence.worst_row(_diag(spark, sf), DIAG_FEATURE, DIAG_TARGET, STORE)


@register("top_argmax_row", sql((*AF_CTES, _diag_sql()), _top_sql(
    "abs(loo_resid)", f"store_id, date, {DIAG_FEATURE}, {DIAG_TARGET}, {r4('loo_resid')} AS loo_resid")))
def top_argmax_row(spark, sf):
    return influence.worst_row(_diag(spark, sf), DIAG_FEATURE, DIAG_TARGET, STORE)


@register("top_drop_worst", sql((*AF_CTES, _diag_sql()), f"""
SELECT store_id, date, {r4('loo_resid')} AS loo_resid FROM (
    SELECT *, ROW_NUMBER() OVER (PARTITION BY store_id ORDER BY abs(loo_resid) DESC, date ASC) AS rn FROM diag
) t WHERE rn > 1"""))
def top_drop_worst(spark, sf):
    return influence.loocv_report(influence.drop_worst(_diag(spark, sf), STORE), STORE)


_COOKS_COLS = f"store_id, date, {r4('cooks_d')} AS cooks_d, {r4('h')} AS leverage, {r4('threshold')} AS threshold, cooks_d > threshold AS influential"


@register("dia_cooks", sql((*AF_CTES, _diag_sql()), f"SELECT {_COOKS_COLS} FROM diag"))
def dia_cooks(spark, sf):
    return influence.cooks(_diag(spark, sf), STORE)


@register("dia_cooks_flag", sql((*AF_CTES, _diag_sql()), f"SELECT {_COOKS_COLS} FROM diag WHERE cooks_d > threshold"))
def dia_cooks_flag(spark, sf):
    return influence.cooks_flagged(_diag(spark, sf), STORE)


def _prop_sql(grp: str = "store_id") -> tuple[str, str]:
    cols = f"date, {DIAG_FEATURE}, {DIAG_TARGET}, cooks_d"
    cte = f"""
yo AS ({_top_sql('abs(loo_resid)', f'{grp}, {cols}', grp)}),
xo AS ({_top_sql('cooks_d', f'{grp}, {cols}', grp)}),
pj AS (
    SELECT y.*, x.date AS x_date, x.{DIAG_FEATURE} AS x_feat, x.{DIAG_TARGET} AS x_tgt, x.cooks_d AS x_cooks,
           (x.date = y.date + INTERVAL 7 DAY AND x.{DIAG_FEATURE} = y.{DIAG_TARGET}) AS propagated
    FROM yo y JOIN xo x USING ({grp})
)"""
    body = f"""
SELECT {grp}, propagated, 'Y outlier (max residual)' AS kind, date, {DIAG_FEATURE}, {DIAG_TARGET}, {r4('cooks_d')} AS cooks_d FROM pj
UNION ALL
SELECT {grp}, propagated, 'X outlier (max leverage)', CAST(x_date AS DATE), x_feat, x_tgt, {r4('x_cooks')} FROM pj"""
    return cte, body


@register("dia_propagation", sql((*AF_CTES, _diag_sql(), _prop_sql()[0]), _prop_sql()[1]))
def dia_propagation(spark, sf):
    return influence.propagation(_diag(spark, sf), DIAG_FEATURE, DIAG_TARGET, STORE, lag_days=7)


_SNAP = f"""
snap AS (
    SELECT *, 'before' AS snapshot FROM af WHERE date < DATE '{SNAPSHOT_END}'
    UNION ALL
    SELECT *, 'after' FROM af
)"""


@register("dia_before_after", sql((*AF_CTES, _SNAP, _diag_sql("snap", "snapshot, store_id"), _prop_sql("snapshot, store_id")[0]),
                                  _prop_sql("snapshot, store_id")[1]))
def dia_before_after(spark, sf):
    a = af(spark, sf)
    snap = F.explode(F.when(F.col("date") < F.lit(SNAPSHOT_END).cast("date"), F.array(F.lit("before"), F.lit("after")))
                     .otherwise(F.array(F.lit("after"))))
    both = a.withColumn("snapshot", snap)
    groups = ["snapshot", *STORE]
    return influence.propagation(_diag(spark, sf, groups, both), DIAG_FEATURE, DIAG_TARGET, groups, lag_days=7)


@register("cor_with_without_segment", sql((*AF_CTES, _SEG), "\nUNION ALL\n".join(
    f"SELECT store_id, segment, '{c}' AS feature, {i} AS pos, {_pearson_sql(T1, c)} AS r_incl, "
    f"{_pearson_sql(f'CASE WHEN date NOT IN ({_EXCL}) OR date IS NULL THEN {T1} END', f'CASE WHEN date NOT IN ({_EXCL}) OR date IS NULL THEN {c} END')} AS r_excl "
    f"FROM seg GROUP BY store_id, segment"
    for i, c in enumerate(TIME_COLS)
)))
def cor_with_without_segment(spark, sf):
    """With / without the declared outlier dates, per store and weekday segment
    (all days, Tuesdays, Mondays + Fridays), in one pass."""
    return corr.corr_with_without(_segmented(af(spark, sf)), TIME_COLS, T1, [*STORE, "segment"], OUTLIER_DATES)


def _scan_segment_sql() -> str:
    parts = []
    for f in FEATURE_COLUMNS:
        n = f"regr_count({T1}, {f})"
        slope = f"(CASE WHEN regr_sxx({T1}, {f}) = 0 THEN NULL ELSE regr_slope({T1}, {f}) END)"
        sse = f"(regr_syy({T1}, {f}) - {slope} * regr_sxy({T1}, {f}))"
        t = f"{slope} / NULLIF(sqrt(({sse} / NULLIF({n} - 2, 0)) / NULLIF(regr_sxx({T1}, {f}), 0)), 0)"
        parts.append(
            f"SELECT store_id, segment, '{f}' AS feature, CAST({n} AS BIGINT) AS n, {r4(f'regr_r2({T1}, {f})')} AS r2, "
            f"{r4(f'CASE WHEN {n} - 2 > 0 THEN 1 - (1 - regr_r2({T1}, {f})) * ({n} - 1) / ({n} - 2) END')} AS adj_r2, "
            f"{r4(slope)} AS slope, {r4(t)} AS t "
            f"FROM seg WHERE date NOT IN ({_EXCL}) OR date IS NULL GROUP BY store_id, segment"
        )
    return "\nUNION ALL\n".join(parts)


@register("reg_single_scan_segment", sql((*AF_CTES, _SEG), _scan_segment_sql()))
def reg_single_scan_segment(spark, sf):
    """Single-feature scan per store and weekday segment, declared outlier dates excluded."""
    seg = _segmented(af(spark, sf))
    keep = ~F.col("date").isin(*[F.lit(d).cast("date") for d in OUTLIER_DATES]) | F.col("date").isNull()
    scan = regression.single_feature_scan(seg.filter(keep), FEATURE_COLUMNS, T1, [*STORE, "segment"])
    return regression.scan_result(scan)


def _stepwise_segment_sql() -> str:
    keep = f"(date NOT IN ({_EXCL}) OR date IS NULL)"
    ctes = [_ols2("seg", T1, _STEP_BASE, c, where=keep, name=f"g{i}", grp="store_id, segment")
            for i, c in enumerate(_STEP_REMAINING)]
    body = "\nUNION ALL\n".join(
        f"SELECT store_id, segment, '{c}' AS added, n, CAST(rnk AS INTEGER) AS k, df_resid, {r4('r2')} AS r2, "
        f"{r4('adj_r2')} AS adj_r2, {r4('b2 / NULLIF(se2, 0)')} AS t FROM g{i}"
        for i, c in enumerate(_STEP_REMAINING))
    return sql((*AF_CTES, _SEG, *ctes), body)


@register("reg_stepwise_scan_segment", _stepwise_segment_sql())
def reg_stepwise_scan_segment(spark, sf):
    """Stepwise scan (base lag_biweekly_t1 + each candidate) per store and weekday
    segment, declared outlier dates excluded."""
    seg = _segmented(af(spark, sf))
    keep = ~F.col("date").isin(*[F.lit(d).cast("date") for d in OUTLIER_DATES]) | F.col("date").isNull()
    return regression.stepwise_scan(seg.filter(keep), [_STEP_BASE], _STEP_REMAINING, T1, [*STORE, "segment"],
                                    with_p=False)
