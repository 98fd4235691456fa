"""Statistical / model queries of the survey (§2.5, §2.11-2.14).

Samples are per store: the daily totals without Thursdays (H1/H2) and the
paired stage targets (H3). Each ``st_*`` query emits the test statistic and
degrees of freedom (checked against DuckDB); ``st_*_pvalue`` adds the
p-value and decision (rows-only check; known answers in tests/).
"""

from __future__ import annotations

from prepcast.functions.columns import DUMMY_LEVELS, THU
from prepcast.operators import features, stats
from prepcast.plans import tables as T
from prepcast.plans.catalog import register
from prepcast.plans.oracle_sql import DAYT, DECISION, F_P, FEATURE_CTES, H1, H3, T_P, D, R, sql

STORE = ["store_id"]
POPMEAN = 20000.0  # reference's hypothesised daily mean (20 kg)
LEVELS_SQL = ", ".join(f"'{x}'" for x in DUMMY_LEVELS)
H3_CTES = (*FEATURE_CTES[:2], H3)


def r6(x: str) -> str:
    return R(x, 6)


def _with_t(cols: str, t: str, src: str, with_p: bool) -> str:
    """SELECT cols, t (rounded) [, p, decision] FROM src, where src exposes the raw t as _t."""
    if not with_p:
        return f"SELECT {cols}, {r6(t)} AS t FROM ({src}) q"
    p = r6(T_P("_t", "df"))
    return f"SELECT {cols}, {r6(t)} AS t, {p} AS p, {DECISION(p)} AS decision FROM ({src}) q"


def _with_f(cols: str, src: str, with_p: bool) -> str:
    if not with_p:
        return f"SELECT {cols}, {r6('_F')} AS F FROM ({src}) q"
    p = r6(F_P("_F", "df1", "df2"))
    return f"SELECT {cols}, {r6('_F')} AS F, {p} AS p, {DECISION(p)} AS decision FROM ({src}) q"


_T1 = f"""
SELECT store_id, COUNT(sum_g) AS n, {r6('AVG(sum_g)')} AS mean, {r6('STDDEV_SAMP(sum_g)')} AS sd,
       {D(f'AVG(sum_g) - {POPMEAN}', 'STDDEV_SAMP(sum_g) / SQRT(COUNT(sum_g))')} AS _t, COUNT(sum_g) - 1 AS df
FROM h1 GROUP BY store_id"""


@register("st_ttest_1samp", sql((DAYT, H1), _with_t("store_id, n, mean, sd, df", "_t", _T1, False)))
def st_ttest_1samp(spark, sf):
    return stats.ttest_1samp(T.h1(spark, sf), "sum_g", POPMEAN, STORE)


@register("st_ttest_1samp_pvalue", sql((DAYT, H1), _with_t("store_id, n, mean, sd, df", "_t", _T1, True)))
def st_ttest_1samp_pvalue(spark, sf):
    return stats.ttest_1samp(T.h1(spark, sf), "sum_g", POPMEAN, STORE, with_p=True)


def _oneway_sql(src: str, value: str, label: str, where: str, pre: str = "") -> str:
    return f"""
{pre}cell AS (
    SELECT store_id, {label} AS lv, COUNT({value}) AS ni, SUM({value}) AS si, AVG({value}) AS mi,
           VAR_POP({value}) AS vi
    FROM {src} WHERE {value} IS NOT NULL AND {where} GROUP BY 1, 2
),
{pre}tot AS (
    SELECT store_id, COUNT(*) AS k, CAST(SUM(ni) AS BIGINT) AS N, SUM(si) / SUM(ni) AS grand, SUM(ni * vi) AS ssw
    FROM {pre}cell WHERE ni > 0 GROUP BY 1
)"""


def _oneway_src(pre: str = "") -> str:
    return f"""
SELECT t.store_id, t.k, t.N,
       {D('SUM(c.ni * (c.mi - t.grand) * (c.mi - t.grand)) / (t.k - 1)', 't.ssw / (t.N - t.k)')} AS _F,
       t.k - 1 AS df1, t.N - t.k AS df2
FROM {pre}tot t JOIN {pre}cell c ON c.store_id = t.store_id
GROUP BY t.store_id, t.k, t.N, t.ssw, t.grand"""


_ONEWAY_SRC = _oneway_src()
_ONEWAY_BODY = _with_f("store_id, k, N, df1, df2", _ONEWAY_SRC, False)
_ONEWAY_BODY_P = _with_f("store_id, k, N, df1, df2", _ONEWAY_SRC, True)


@register("st_anova", sql((DAYT, H1, _oneway_sql("h1", "sum_g", "day_of_week", f"day_of_week IN ({LEVELS_SQL})")),
                          _ONEWAY_BODY))
def st_anova(spark, sf):
    return stats.anova(T.h1(spark, sf), "sum_g", "day_of_week", STORE)


@register("st_anova_pvalue", sql((DAYT, H1, _oneway_sql("h1", "sum_g", "day_of_week", f"day_of_week IN ({LEVELS_SQL})")),
                                 _ONEWAY_BODY_P))
def st_anova_pvalue(spark, sf):
    return stats.anova(T.h1(spark, sf), "sum_g", "day_of_week", STORE, with_p=True)


_LEV = f"""
med AS (
    SELECT store_id, day_of_week, quantile_cont(sum_g, 0.5) AS med FROM h1
    WHERE sum_g IS NOT NULL AND day_of_week IN ({LEVELS_SQL}) GROUP BY 1, 2
),
zt AS (
    SELECT h1.store_id, h1.day_of_week, ABS(h1.sum_g - med.med) AS z
    FROM h1 JOIN med ON h1.store_id = med.store_id AND h1.day_of_week = med.day_of_week
    WHERE h1.sum_g IS NOT NULL
)"""


@register("st_levene", sql((DAYT, H1, _LEV, _oneway_sql("zt", "z", "day_of_week", "TRUE")), _ONEWAY_BODY))
def st_levene(spark, sf):
    return stats.levene(T.h1(spark, sf), "sum_g", "day_of_week", STORE)


@register("st_levene_pvalue", sql((DAYT, H1, _LEV, _oneway_sql("zt", "z", "day_of_week", "TRUE")), _ONEWAY_BODY_P))
def st_levene_pvalue(spark, sf):
    return stats.levene(T.h1(spark, sf), "sum_g", "day_of_week", STORE, with_p=True)


def _cond(agg: str, lv: int) -> str:
    return f"{agg}(CASE WHEN is_pre_holiday = {lv} THEN sum_g END)"


_TI = f"""
SELECT store_id, n_a, n_b, {r6('mean_a')} AS mean_a, {r6('mean_b')} AS mean_b,
       {D('mean_a - mean_b', 'SQRT(' + D('(n_a - 1) * var_a + (n_b - 1) * var_b', 'n_a + n_b - 2') + ' * (1.0 / n_a + 1.0 / n_b))')} AS _t,
       n_a + n_b - 2 AS df
FROM (
    SELECT store_id, {_cond('COUNT', 0)} AS n_a, {_cond('AVG', 0)} AS mean_a, {_cond('VAR_SAMP', 0)} AS var_a,
           {_cond('COUNT', 1)} AS n_b, {_cond('AVG', 1)} AS mean_b, {_cond('VAR_SAMP', 1)} AS var_b
    FROM h1 WHERE sum_g IS NOT NULL AND is_pre_holiday IN (0, 1) GROUP BY store_id
) s"""


@register("st_ttest_ind", sql((DAYT, H1), _with_t("store_id, n_a, n_b, mean_a, mean_b, df", "_t", _TI, False)))
def st_ttest_ind(spark, sf):
    return stats.ttest_ind(T.h1(spark, sf), "sum_g", "is_pre_holiday", STORE)


@register("st_ttest_ind_pvalue", sql((DAYT, H1), _with_t("store_id, n_a, n_b, mean_a, mean_b, df", "_t", _TI, True)))
def st_ttest_ind_pvalue(spark, sf):
    return stats.ttest_ind(T.h1(spark, sf), "sum_g", "is_pre_holiday", STORE, with_p=True)


_PAIRS = "(SELECT store_id, cumul_16_19 - cumul_20_22 AS d FROM h3 WHERE cumul_16_19 IS NOT NULL AND cumul_20_22 IS NOT NULL)"


_TR = f"""
SELECT store_id, COUNT(d) AS n, {r6('AVG(d)')} AS mean_diff, {r6('STDDEV_SAMP(d)')} AS sd_diff,
       {D('AVG(d)', 'STDDEV_SAMP(d) / SQRT(COUNT(d))')} AS _t, COUNT(d) - 1 AS df
FROM {_PAIRS} p GROUP BY store_id"""


@register("st_ttest_rel", sql(H3_CTES, _with_t("store_id, n, mean_diff, sd_diff, df", "_t", _TR, False)))
def st_ttest_rel(spark, sf):
    return stats.ttest_rel(T.h3(spark, sf), "cumul_16_19", "cumul_20_22", STORE)


@register("st_ttest_rel_pvalue", sql(H3_CTES, _with_t("store_id, n, mean_diff, sd_diff, df", "_t", _TR, True)))
def st_ttest_rel_pvalue(spark, sf):
    return stats.ttest_rel(T.h3(spark, sf), "cumul_16_19", "cumul_20_22", STORE, with_p=True)


@register("st_cohens_d", sql(H3_CTES, f"""
SELECT store_id, COUNT(d) AS n, {r6(D('AVG(d)', 'STDDEV_SAMP(d)'))} AS cohens_d FROM {_PAIRS} p GROUP BY store_id"""))
def st_cohens_d(spark, sf):
    return stats.cohens_d(T.h3(spark, sf), "cumul_16_19", "cumul_20_22", STORE)


_WIL = f"""
wz AS (SELECT store_id, CAST(SUM(CASE WHEN d = 0 THEN 1 ELSE 0 END) AS BIGINT) AS zeros FROM {_PAIRS} p WHERE d IS NOT NULL GROUP BY 1),
nz AS (SELECT store_id, d, ABS(d) AS a FROM {_PAIRS} p WHERE d <> 0),
cnt AS (SELECT store_id, a, COUNT(*) AS c, SUM(CASE WHEN d > 0 THEN 1 ELSE 0 END) AS pos FROM nz GROUP BY 1, 2),
rk AS (
    SELECT *, COALESCE(SUM(c) OVER (PARTITION BY store_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
              + (c + 1) / 2.0 AS rnk
    FROM cnt
),
wagg AS (
    SELECT store_id, CAST(SUM(c) AS BIGINT) AS n, SUM(pos * rnk) AS w_plus, SUM((c - pos) * rnk) AS w_minus,
           SUM(CAST(c AS DOUBLE) * c * c - c) AS tie, MAX(c) AS maxc
    FROM rk GROUP BY 1
)"""


_WSRC = f"""
SELECT store_id, n, zeros, {r6('w_plus')} AS w_plus, {r6('w_minus')} AS w_minus, {r6('LEAST(w_plus, w_minus)')} AS statistic,
       {D('LEAST(w_plus, w_minus) - n * (n + 1) / 4.0', 'SQRT(n * (n + 1) * (2 * n + 1) / 24.0 - tie / 48.0)')} AS _z,
       (n <= 50 AND COALESCE(maxc, 0) = 1 AND zeros = 0) AS exact
FROM (SELECT wz.store_id, wz.zeros, COALESCE(w.n, 0) AS n, w_plus, w_minus, tie, maxc
      FROM wz LEFT JOIN wagg w ON wz.store_id = w.store_id) w"""


def _wilcoxon_body(with_p: bool) -> str:
    from prepcast.functions.tails import wilcoxon_p_sql

    cols = "store_id, n, zeros, w_plus, w_minus, statistic, exact, " + r6("_z") + " AS z"
    if not with_p:
        return f"SELECT {cols} FROM ({_WSRC}) q"
    p = r6(wilcoxon_p_sql("statistic", "n", "_z", "exact", engine="duckdb"))
    return f"SELECT {cols}, {p} AS p, {DECISION(p)} AS decision FROM ({_WSRC}) q"


def _wilcoxon_both() -> str:
    """Exact (any ties, to 50 differences) and normal p side by side; the exact one counts over every single rank."""
    from prepcast.functions.normal import norm_sf_sql

    cols = f"store_id, n, zeros, w_plus, w_minus, statistic, {r6('_z')} AS z"
    ways = ("list_reduce(ranks, lambda c, k: list_transform(range(0, len(c) + k), lambda s: coalesce(c[s + 1], 0.0) + "
            "CASE WHEN s >= k THEN coalesce(c[s - k + 1], 0.0) ELSE 0.0 END), [1.0]::DOUBLE[])")
    exact = r6(f"CASE WHEN n BETWEEN 1 AND 50 THEN LEAST(1.0, 2.0 * list_sum(({ways})[1:CAST(floor(2 * statistic) AS BIGINT) + 1]) / pow(2.0, n)) END")
    approx = r6(f"CASE WHEN n > 0 THEN 2.0 * {norm_sf_sql('abs(_z)')} END")
    return (f"SELECT *, {DECISION('p_exact')} AS decision_exact, {DECISION('p_approx')} AS decision_approx FROM (SELECT {cols}, {exact} AS p_exact, {approx} AS p_approx FROM ({_WSRC}) q "
            "LEFT JOIN (SELECT store_id AS sid, list(CAST(2 * rnk AS BIGINT)) AS ranks FROM (SELECT store_id, rnk, UNNEST(range(c)) FROM rk) u GROUP BY 1) l ON l.sid = q.store_id) w")


@register("st_wilcoxon", sql((*H3_CTES, _WIL), _wilcoxon_body(False)))
def st_wilcoxon(spark, sf):
    return stats.wilcoxon(T.h3(spark, sf), "cumul_16_19", "cumul_20_22", STORE)


@register("st_wilcoxon_pvalue", sql((*H3_CTES, _WIL), _wilcoxon_both()))
def st_wilcoxon_pvalue(spark, sf):
    """Exact and normal p in two columns: no rule picks one of them."""
    return stats.wilcoxon(T.h3(spark, sf), "cumul_16_19", "cumul_20_22", STORE, with_p=True, method="both")


def _shapiro_long(spark, sf):
    """All three samples from the same daily table: each day contributes one row
    per sample it belongs to (weekday totals exclude Thursdays, the paired
    differences use every day)."""
    from pyspark.sql import functions as F

    tt = features.stage_targets(T.tt(spark, sf))
    not_thu = F.col("day_of_week") != THU
    entries = F.array(
        F.struct(F.lit("sum_g").alias("sample"), F.col("sum_g").alias("x"), not_thu.alias("keep")),
        F.struct(F.concat(F.lit("sum_g|"), F.col("day_of_week")).alias("sample"), F.col("sum_g").alias("x"),
                 (not_thu & F.col("day_of_week").isin(*DUMMY_LEVELS)).alias("keep")),
        F.struct(F.lit("diff_16_19_minus_20_22").alias("sample"), (F.col("cumul_16_19") - F.col("cumul_20_22")).alias("x"),
                 F.lit(True).alias("keep")),
    )
    return tt.select(*STORE, F.inline(entries)).filter(F.col("keep") & F.col("sample").isNotNull())


def _shapiro_sql(with_p: bool = False, long_cte: str | None = None, base_ctes: tuple | None = None) -> str:
    from prepcast.functions.normal import norm_ppf_sql
    from prepcast.operators.stats import _SW_C1, _SW_C2

    def poly(c, x):
        out = repr(c[-1])
        for v in reversed(c[:-1]):
            out = f"({out} * {x} + {v!r})"
        return out

    u = "(1.0 / sqrt(n))"
    an = f"(mn / sqrt(ssm) + {poly(_SW_C1, u)})"
    an1 = f"(mn1 / sqrt(ssm) + {poly(_SW_C2, u)})"
    phi = (f"(CASE WHEN n > 5 THEN (ssm - 2 * mn * mn - 2 * mn1 * mn1) / (1 - 2 * {an} * {an} - 2 * {an1} * {an1}) "
           f"ELSE (ssm - 2 * mn * mn) / (1 - 2 * {an} * {an}) END)")
    a = (f"(CASE WHEN n = 3 THEN (CASE WHEN i = 1 THEN -sqrt(0.5) WHEN i = 3 THEN sqrt(0.5) ELSE 0.0 END) "
         f"WHEN i = n THEN {an} WHEN i = 1 THEN -{an} WHEN n > 5 AND i = n - 1 THEN {an1} "
         f"WHEN n > 5 AND i = 2 THEN -{an1} ELSE m / sqrt({phi}) END)")
    levels = ", ".join(f"'{x}'" for x in DUMMY_LEVELS)
    default_long = f"""
slong AS (
    SELECT store_id, 'sum_g' AS sample, sum_g AS x FROM tt WHERE day_of_week != '{THU}'
    UNION ALL
    SELECT store_id, 'sum_g|' || day_of_week, sum_g FROM tt WHERE day_of_week != '{THU}' AND day_of_week IN ({levels})
    UNION ALL
    SELECT store_id, 'diff_16_19_minus_20_22', cumul_16_19 - cumul_20_22 FROM h3
),"""
    ctes = (long_cte or default_long) + f"""
sv AS (SELECT * FROM slong WHERE x IS NOT NULL AND sample IS NOT NULL),
ssz AS (SELECT store_id, sample, COUNT(*) AS n FROM sv GROUP BY 1, 2),
sr AS (
    SELECT v.store_id, v.sample, v.x, z.n,
           ROW_NUMBER() OVER (PARTITION BY v.store_id, v.sample ORDER BY v.x) AS i
    FROM sv v JOIN ssz z ON v.store_id = z.store_id AND v.sample = z.sample
    WHERE z.n >= 3
),
sm AS (SELECT *, {norm_ppf_sql('((i - 0.375) / (n + 0.25))')} AS m FROM sr),
sw AS (
    SELECT *, SUM(m * m) OVER g AS ssm, MAX(m) OVER g AS mn,
           MAX(CASE WHEN i = n - 1 THEN m END) OVER g AS mn1, AVG(x) OVER g AS xbar
    FROM sm WINDOW g AS (PARTITION BY store_id, sample)
),
sa AS (SELECT store_id, sample, n, x, xbar, {a} AS a FROM sw)"""
    body = f"""
SELECT store_id, sample, n, LEAST(1.0, SUM(a * x) * SUM(a * x) / NULLIF(SUM((x - xbar) * (x - xbar)), 0)) AS _w,
       CAST(NULL AS VARCHAR) AS reason
FROM sa GROUP BY store_id, sample, n
UNION ALL
SELECT store_id, sample, n, CAST(NULL AS DOUBLE), 'n<3'
FROM ssz WHERE n < 3"""
    extra = ""
    if with_p:
        from prepcast.functions.tails import shapiro_p_sql

        p = r6(shapiro_p_sql("_w", "n"))
        extra = f", {p} AS p, CASE WHEN {p} IS NULL THEN NULL ELSE {p} > 0.05 END AS normal"
    body = f"SELECT store_id, sample, n, {R('_w', 6)} AS W, reason{extra} FROM ({body}) q"
    return sql((*(base_ctes or H3_CTES), ctes), body)


@register("st_shapiro", _shapiro_sql())
def st_shapiro(spark, sf):
    """Shapiro-Wilk W for the whole sample, per weekday and on the paired
    differences, per store, in one grouped pass."""
    return stats.shapiro(_shapiro_long(spark, sf), "x", [*STORE, "sample"], with_p=False)


@register("st_shapiro_pvalue", _shapiro_sql(with_p=True))
def st_shapiro_pvalue(spark, sf):
    return stats.shapiro(_shapiro_long(spark, sf), "x", [*STORE, "sample"])


def _decision_sql() -> str:
    ctes = (DAYT, H1, *H3_CTES,
            _oneway_sql("h1", "sum_g", "day_of_week", f"day_of_week IN ({LEVELS_SQL})", pre="a_"),
            _LEV, _oneway_sql("zt", "z", "day_of_week", "TRUE", pre="l_"), _WIL)
    parts = [
        ("ttest_1samp", "t", _with_t("store_id, n, mean, sd, df", "_t", _T1, True)),
        ("anova", "F", _with_f("store_id, k, N, df1, df2", _oneway_src("a_"), True)),
        ("levene", "F", _with_f("store_id, k, N, df1, df2", _oneway_src("l_"), True)),
        ("ttest_ind", "t", _with_t("store_id, n_a, n_b, mean_a, mean_b, df", "_t", _TI, True)),
        ("ttest_rel", "t", _with_t("store_id, n, mean_diff, sd_diff, df", "_t", _TR, True)),
        ("wilcoxon", "statistic", _wilcoxon_body(True)),
    ]
    body = "\nUNION ALL\n".join(
        f"SELECT store_id, '{name}' AS test, {stat} AS statistic, p, decision FROM ({q}) {name}_q" for name, stat, q in parts)
    return sql(ctes, body)


@register("st_decision", _decision_sql())
def st_decision(spark, sf):
    """H1-H3 summary per store: test, statistic, p and decision in one long table."""
    from pyspark.sql import functions as F

    h1, h3 = T.h1(spark, sf), T.h3(spark, sf)

    def long(df, test, stat):
        return df.select(*STORE, F.lit(test).alias("test"), F.col(stat).alias("statistic"), "p", "decision")

    return (
        long(stats.ttest_1samp(h1, "sum_g", POPMEAN, STORE, with_p=True), "ttest_1samp", "t")
        .unionByName(long(stats.anova(h1, "sum_g", "day_of_week", STORE, with_p=True), "anova", "F"))
        .unionByName(long(stats.levene(h1, "sum_g", "day_of_week", STORE, with_p=True), "levene", "F"))
        .unionByName(long(stats.ttest_ind(h1, "sum_g", "is_pre_holiday", STORE, with_p=True), "ttest_ind", "t"))
        .unionByName(long(stats.ttest_rel(h3, "cumul_16_19", "cumul_20_22", STORE, with_p=True), "ttest_rel", "t"))
        .unionByName(long(stats.wilcoxon(h3, "cumul_16_19", "cumul_20_22", STORE, with_p=True), "wilcoxon", "statistic"))
    )


_LEV_STATUS = """
med_s AS (
    SELECT store_id, is_pre_holiday, quantile_cont(sum_g, 0.5) AS med FROM h1
    WHERE sum_g IS NOT NULL AND is_pre_holiday IN (0, 1) GROUP BY 1, 2
),
zs AS (
    SELECT h1.store_id, h1.is_pre_holiday, ABS(h1.sum_g - med_s.med) AS z
    FROM h1 JOIN med_s ON h1.store_id = med_s.store_id AND h1.is_pre_holiday = med_s.is_pre_holiday
    WHERE h1.sum_g IS NOT NULL
)"""
_LEV_STATUS_CTES = (DAYT, H1, _LEV_STATUS, _oneway_sql("zs", "z", "is_pre_holiday", "TRUE", pre="s_"))


@register("st_levene_status", sql(_LEV_STATUS_CTES, _with_f("store_id, k, N, df1, df2", _oneway_src("s_"), False)))
def st_levene_status(spark, sf):
    """Levene (median centre) between regular days and pre-holiday days (the H2 groups)."""
    return stats.levene(T.h1(spark, sf), "sum_g", "is_pre_holiday", STORE, levels=[0, 1])


@register("st_levene_status_pvalue", sql(_LEV_STATUS_CTES, _with_f("store_id, k, N, df1, df2", _oneway_src("s_"), True)))
def st_levene_status_pvalue(spark, sf):
    return stats.levene(T.h1(spark, sf), "sum_g", "is_pre_holiday", STORE, levels=[0, 1], with_p=True)


_STATUS_LONG = """
slong AS (
    SELECT store_id, 'status|' || CAST(is_pre_holiday AS VARCHAR) AS sample, sum_g AS x FROM h1
    WHERE is_pre_holiday IN (0, 1)
),"""


def _status_long(spark, sf):
    from pyspark.sql import functions as F

    h1 = T.h1(spark, sf).filter(F.col("is_pre_holiday").isin(0, 1))
    return h1.select(*STORE, F.concat(F.lit("status|"), F.col("is_pre_holiday").cast("string")).alias("sample"),
                     F.col("sum_g").alias("x"))


@register("st_shapiro_status", _shapiro_sql(long_cte=_STATUS_LONG, base_ctes=(DAYT, H1)))
def st_shapiro_status(spark, sf):
    """Shapiro-Wilk W per store for regular and pre-holiday days (the H2 groups)."""
    return stats.shapiro(_status_long(spark, sf), "x", [*STORE, "sample"], with_p=False)


@register("st_shapiro_status_pvalue", _shapiro_sql(with_p=True, long_cte=_STATUS_LONG, base_ctes=(DAYT, H1)))
def st_shapiro_status_pvalue(spark, sf):
    return stats.shapiro(_status_long(spark, sf), "x", [*STORE, "sample"])
