"""Single-operator queries of the survey (§2.1-2.7): each isolates one operator
on the whole fixture tables, with its DuckDB oracle."""

from __future__ import annotations

from pyspark.sql import functions as F

from prepcast.functions.columns import (
    BINS30, FRI, THU, WEEKDAY_LABELS, bin30, bin60, from_units, g_to_kg, holiday_flag, rnd,
)
from prepcast.operators import daily, describe, features, kpi, peaks
from prepcast.plans import tables as T
from prepcast.plans.catalog import register
from prepcast.plans.oracle_sql import (
    BIN30_SQL, BIN60_SQL, DAYT, DEC, FEATURE_CTES, H1, HOLIDAY, JT, TT, D, R, q, sql,
)
from prepcast.plans.q_model import _BT, AF_CTES, CANDIDATES_T2, OUTLIER_DATES, STORE, T1, T2, _cramer, _ols2, af
from prepcast.plans.q_tables import MONTH, VALIDATION_END, VALIDATION_START
from prepcast.session import scratch_path
from prepcast.sources import logs
from prepcast.sources.publish import publish, published, replace_dates

H1_CTES = (DAYT, H1)

# ------------------------------------------------------------------ projections


@register("prj_rename", sql((), f"""
SELECT day_id, date, day_of_week, {HOLIDAY} AS holiday_status, first_fried_kg, second_fried_kg,
       {R('first_fried_kg + second_fried_kg', 2)} AS total_fired_kg, plus_kg, end_g FROM dcl"""))
def prj_rename(spark, sf):
    return daily.clean_daily_base(T.dcl(spark, sf)).drop("store_id")


@register("prj_bin30", sql((), f"SELECT day_id, order_id, {BIN30_SQL} AS hh_mm FROM odl"))
def prj_bin30(spark, sf):
    return T.odl(spark, sf).select("day_id", "order_id", bin30(F.col("order_datetime")).alias("hh_mm"))


@register("prj_bin60", sql((), f"SELECT day_id, order_id, {BIN60_SQL} AS bin_hour FROM odl"))
def prj_bin60(spark, sf):
    return T.odl(spark, sf).select("day_id", "order_id", bin60(F.col("order_datetime")).alias("bin_hour"))


@register("prj_holiday_flag", sql((), f"SELECT day_id, is_holiday, is_pre_holiday, {HOLIDAY} AS holiday_status FROM dcl"))
def prj_holiday_flag(spark, sf):
    return T.dcl(spark, sf).select("day_id", "is_holiday", "is_pre_holiday",
                                   holiday_flag(F.col("is_holiday"), F.col("is_pre_holiday")).alias("holiday_status"))


@register("prj_total_fired", sql((), f"SELECT day_id, {R('first_fried_kg + second_fried_kg', 2)} AS total_fired_kg FROM dcl"))
def prj_total_fired(spark, sf):
    d = T.dcl(spark, sf)
    return d.select("day_id", daily.total_fired(d).alias("total_fired_kg"))


@register("prj_plus_kg", sql((), "SELECT day_id, COALESCE(plus_kg, 0) AS plus_kg FROM dcl"))
def prj_plus_kg(spark, sf):
    return T.dcl(spark, sf).select("day_id", F.coalesce(F.col("plus_kg"), F.lit(0.0)).alias("plus_kg"))


@register("prj_act_g", sql((DAYT,), """
SELECT d.day_id, t.sum_g - d.plus_kg * 1000 AS act_g_raw, t.sum_g - COALESCE(d.plus_kg, 0) * 1000 AS act_g_coalesced
FROM dcl d JOIN dayt t ON d.day_id = t.day_id"""))
def prj_act_g(spark, sf):
    t = daily.day_totals(T.odl(spark, sf), ["day_id"])
    j = T.dcl(spark, sf).join(t, "day_id")
    return j.select("day_id", daily.act_g(F.col("sum_g"), F.col("plus_kg")).alias("act_g_raw"),
                    daily.act_g(F.col("sum_g"), F.coalesce(F.col("plus_kg"), F.lit(0.0))).alias("act_g_coalesced"))


_S1 = " + ".join(q(b) for b in BINS30[:8])
_S2 = " + ".join(q(b) for b in BINS30[8:])


@register("prj_stage_targets", sql((JT, TT), f"SELECT day_id, ({_S1}) AS cumul_16_19, ({_S2}) AS cumul_20_22 FROM tt"))
def prj_stage_targets(spark, sf):
    return features.stage_targets(T.tt(spark, sf)).select("day_id", T1, T2)


@register("prj_g_to_kg", sql((DAYT,), f"SELECT day_id, {R(D('sum_g', '1000.0'), 2)} AS amount_kg FROM dayt"))
def prj_g_to_kg(spark, sf):
    t = daily.day_totals(T.odl(spark, sf), ["day_id"])
    return t.select("day_id", g_to_kg(F.col("sum_g")).alias("amount_kg"))


@register("prj_columns", sql(FEATURE_CTES, "SELECT * EXCLUDE (day_id, store_id, date, day_of_week) FROM mf"))
def prj_columns(spark, sf):
    mf = T.mf(spark, sf)
    numeric = [n for n, t in mf.dtypes if t in ("double", "int", "bigint", "float", "smallint", "tinyint")]
    return mf.select(*numeric)


@register("prj_concat_cols", sql(AF_CTES, "SELECT day_id, cumul_16_19, dow_tue, dow_fri FROM af"))
def prj_concat_cols(spark, sf):
    return af(spark, sf).select("day_id", T1, "dow_tue", "dow_fri")


@register("prj_dummies", sql(AF_CTES, "SELECT day_id, day_of_week, dow_tue, dow_fri FROM af"))
def prj_dummies(spark, sf):
    return af(spark, sf).select("day_id", "day_of_week", "dow_tue", "dow_fri")


@register("prj_cast", sql(FEATURE_CTES, """
SELECT day_id, CAST(CAST(date AS VARCHAR) AS DATE) AS date, TRY_CAST(CAST(before_rest AS VARCHAR) AS DOUBLE) AS before_rest
FROM mf"""))
def prj_cast(spark, sf):
    mf = T.mf(spark, sf)
    return mf.select("day_id", F.to_date(F.col("date").cast("string")).alias("date"),
                     F.col("before_rest").cast("string").try_cast("double").alias("before_rest"))


_OH_LEVELS = [x for x in WEEKDAY_LABELS if x not in (THU, WEEKDAY_LABELS[0])]


@register("prj_onehot_drop", sql(FEATURE_CTES, "SELECT day_id, " + ", ".join(
    f"CAST(day_of_week = '{lv}' AS DOUBLE) AS {q('day_of_week_' + lv)}" for lv in sorted(_OH_LEVELS)) + " FROM mf"))
def prj_onehot_drop(spark, sf):
    """One-hot with levels inferred from the data, baseline level dropped.

    The levels (at most seven weekdays) are read from the daily log, which the
    feature table keeps every weekday of but the excluded one."""
    mf = T.mf(spark, sf)
    seen = T.dcl(spark, sf).where(F.col("day_of_week") != THU).select("day_of_week").distinct().collect()
    levels = sorted(r[0] for r in seen if r[0] is not None)
    return mf.select("day_id", *[(F.col("day_of_week") == lv).cast("double").alias(f"day_of_week_{lv}")
                                 for lv in levels if lv != WEEKDAY_LABELS[0]])


@register("prj_is_friday", sql(FEATURE_CTES, f"""
SELECT day_id, CAST(1.0 AS DOUBLE) AS const, CAST(day_of_week = '{FRI}' AS INTEGER) AS dow_fri, roll_prev_3days_mean_t2
FROM mf WHERE date >= DATE '{VALIDATION_START}' AND date < DATE '{VALIDATION_END}'"""))
def prj_is_friday(spark, sf):
    v = features.validation_set(T.mf(spark, sf), VALIDATION_START, VALIDATION_END)
    return v.select("day_id", F.lit(1.0).alias("const"), (F.col("day_of_week") == FRI).cast("int").alias("dow_fri"),
                    "roll_prev_3days_mean_t2")


# ------------------------------------------------------------------ filters


@register("flt_exclude_dow", sql((), f"SELECT day_id, day_of_week FROM dcl WHERE day_of_week != '{THU}'"))
def flt_exclude_dow(spark, sf):
    return features.exclude_weekday(T.dcl(spark, sf)).select("day_id", "day_of_week")


@register("flt_month_prefix", sql(FEATURE_CTES, f"""
SELECT day_id, date, roll_prev_3days_mean_t2 FROM mf
WHERE date >= DATE '{MONTH}-01' AND date < DATE '{MONTH}-01' + INTERVAL 1 MONTH"""))
def flt_month_prefix(spark, sf):
    return features.month_filter(T.mf(spark, sf), MONTH).select("day_id", "date", "roll_prev_3days_mean_t2")


_SHARE = f"""
cum_bin AS (SELECT day_id, {BIN30_SQL} AS hh_mm, SUM({DEC}) AS cum_bin FROM odl GROUP BY 1, 2),
share AS (
    SELECT day_id, hh_mm, CAST(cum_bin AS DOUBLE) AS cum_bin,
           CAST(SUM(cum_bin) OVER (PARTITION BY day_id) AS DOUBLE) AS total,
           {R(D('cum_bin', 'SUM(cum_bin) OVER (PARTITION BY day_id)') + ' * 100', 2)} AS pct,
           {R(D('SUM(cum_bin) OVER (PARTITION BY day_id ORDER BY hh_mm)', 'SUM(cum_bin) OVER (PARTITION BY day_id)') + ' * 100', 2)} AS cum_pct
    FROM cum_bin
),
stats AS (
    SELECT *, {R('AVG(pct) OVER (PARTITION BY day_id) + STDDEV_POP(pct) OVER (PARTITION BY day_id)', 2)} AS daily_peak_pct
    FROM share
)"""


def _share(spark, sf):
    return peaks.share_table(T.odl(spark, sf))


def _stats(spark, sf):
    from pyspark.sql import Window

    day = Window.partitionBy("day_id")
    s = _share(spark, sf)
    return s.withColumn("daily_peak_pct", rnd(F.avg("pct").over(day) + F.stddev_pop("pct").over(day), 2))


@register("flt_gt_threshold", sql((_SHARE,), "SELECT day_id, hh_mm, pct FROM stats WHERE pct > daily_peak_pct"))
def flt_gt_threshold(spark, sf):
    return _stats(spark, sf).filter(F.col("pct") > F.col("daily_peak_pct")).select("day_id", "hh_mm", "pct")


@register("flt_eq_segment", sql(AF_CTES, "SELECT store_id, day_id FROM af WHERE dow_tue = 1"))
def flt_eq_segment(spark, sf):
    return af(spark, sf).filter(F.col("dow_tue") == 1).select("store_id", "day_id")


_EXCL = ", ".join(f"DATE '{d}'" for d in OUTLIER_DATES)


@register("flt_exclude_dates", sql(AF_CTES, f"SELECT store_id, day_id FROM af WHERE date NOT IN ({_EXCL}) OR date IS NULL"))
def flt_exclude_dates(spark, sf):
    a = af(spark, sf)
    keep = ~F.col("date").isin(*[F.lit(d).cast("date") for d in OUTLIER_DATES]) | F.col("date").isNull()
    return a.filter(keep).select("store_id", "day_id")


_Q = """
fence AS (
    SELECT store_id, quantile_cont(sum_g, 0.25) AS q1, quantile_cont(sum_g, 0.75) AS q3 FROM h1
    WHERE sum_g IS NOT NULL GROUP BY store_id
),
fence2 AS (SELECT *, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM fence)"""


@register("flt_iqr_outlier", sql((*H1_CTES, _Q), """
SELECT h1.store_id, h1.day_id, h1.sum_g FROM h1 JOIN fence2 f ON h1.store_id = f.store_id
WHERE h1.sum_g < f.lower OR h1.sum_g > f.upper"""))
def flt_iqr_outlier(spark, sf):
    return describe.iqr_outliers(T.h1(spark, sf), "sum_g", STORE).select("store_id", "day_id", "sum_g")


@register("flt_complete_cases", sql(AF_CTES, "SELECT store_id, day_id FROM af WHERE " + " AND ".join(
    f"{x} IS NOT NULL" for x in [*CANDIDATES_T2, T2])))
def flt_complete_cases(spark, sf):
    return af(spark, sf).dropna(subset=[*CANDIDATES_T2, T2]).select("store_id", "day_id")


@register("flt_not", sql((*AF_CTES, _BT), "SELECT store_id, day_id FROM win WHERE NOT B_wins_both"))
def flt_not(spark, sf):
    from prepcast.plans.q_model import bt_wins

    return bt_wins(spark, sf).filter(~F.col("B_wins_both")).select("store_id", "day_id")


# ------------------------------------------------------------------ joins


@register("join_daily_bins", sql((JT, TT), "SELECT day_id, day_of_week, sum_g, cnt FROM tt"))
def join_daily_bins(spark, sf):
    return T.tt(spark, sf).select("day_id", "day_of_week", "sum_g", "cnt")


@register("join_then_group", sql(H1_CTES, "SELECT day_id, day_of_week, sum_g FROM h1"))
def join_then_group(spark, sf):
    return T.h1(spark, sf).select("day_id", "day_of_week", "sum_g")


@register("join_left_group", sql((DAYT,), f"""
SELECT d.day_id, {R('t.sum_g / 1000', 2)} AS amount_kg FROM dcl d LEFT JOIN dayt t ON d.day_id = t.day_id"""))
def join_left_group(spark, sf):
    return kpi.carry_inputs(T.odl(spark, sf), T.dcl(spark, sf)).select("day_id", "amount_kg")


@register("join_left_group_closed_day", sql((), f"""
SELECT d.day_id, {R('t.sum_g / 1000', 2)} AS amount_kg
FROM dcl d LEFT JOIN (SELECT l.day_id, CAST(SUM({DEC}) AS DOUBLE) AS sum_g
                      FROM (SELECT * FROM odl WHERE isodow(order_date) <> 4) l GROUP BY l.day_id) t ON d.day_id = t.day_id"""))
def join_left_group_closed_day(spark, sf):
    """No lines are taken on the weekly closing day; its rows of the daily log stay, without an amount."""
    open_days = T.odl(spark, sf).where(F.weekday("order_date") != 3)
    return kpi.carry_inputs(open_days, T.dcl(spark, sf)).select("day_id", "amount_kg")


@register("join_derived", sql((DAYT,), f"""
SELECT d.day_id, d.is_holiday, {R('t.sum_g / 1000', 2)} AS sum_kg FROM dcl d JOIN dayt t ON d.day_id = t.day_id"""))
def join_derived(spark, sf):
    return peaks.holiday_totals(T.odl(spark, sf), T.dcl(spark, sf)).select("day_id", "is_holiday", "sum_kg")


@register("join_group_stats", sql((_SHARE,), "SELECT day_id, hh_mm, pct, daily_peak_pct FROM stats"))
def join_group_stats(spark, sf):
    return _stats(spark, sf).select("day_id", "hh_mm", "pct", "daily_peak_pct")


# ------------------------------------------------------------------ aggregations


@register("agg_daily_total", sql((DAYT,), "SELECT day_id, sum_g, cnt FROM dayt"))
def agg_daily_total(spark, sf):
    return daily.day_totals(T.odl(spark, sf), ["day_id"])


@register("agg_pivot_bins", sql((JT,), "SELECT * FROM jt"))
def agg_pivot_bins(spark, sf):
    return daily.pivot_bins(T.odl(spark, sf))


@register("agg_bin_sum", sql((), f"""
SELECT day_id, {BIN30_SQL} AS hh_mm, CAST(SUM({DEC}) AS DOUBLE) AS cum_bin FROM odl GROUP BY 1, 2"""))
def agg_bin_sum(spark, sf):
    s = peaks.bin_sums(T.odl(spark, sf), "hh_mm", 30)
    return s.select("day_id", "hh_mm", from_units(F.col("cum_units")).alias("cum_bin"))


@register("agg_group_by_pk", sql(H1_CTES, "SELECT day_id, day_of_week, is_pre_holiday, sum_g FROM h1"))
def agg_group_by_pk(spark, sf):
    return T.h1(spark, sf).select("day_id", "day_of_week", "is_pre_holiday", "sum_g")


@register("agg_avg_stddev", sql((_SHARE,), f"""
SELECT day_id, {R('AVG(pct)', 6)} AS daily_avg, {R('STDDEV_POP(pct)', 6)} AS daily_std FROM share GROUP BY day_id"""))
def agg_avg_stddev(spark, sf):
    return _share(spark, sf).groupBy("day_id").agg(rnd(F.avg("pct"), 6).alias("daily_avg"),
                                                   rnd(F.stddev_pop("pct"), 6).alias("daily_std"))


_FS = "(d.first_fried_kg + d.second_fried_kg)"


@register("agg_case_inputs", sql((DAYT,), f"""
SELECT d.day_id, {R(_FS, 2)} AS total_fried, {R('d.end_g / 1000', 2)} AS end_amount,
       {R('t.sum_g / 1000 - COALESCE(d.plus_kg, 0)', 2)} AS amount_kg,
       {R(f'{_FS} - ((d.end_g + t.sum_g) / 1000 - COALESCE(d.plus_kg, 0))', 1)} AS ex_fried_kg
FROM dcl d JOIN dayt t ON d.day_id = t.day_id"""))
def agg_case_inputs(spark, sf):
    t = daily.day_totals(T.odl(spark, sf), ["day_id"]).select("day_id", "sum_g")
    j = T.dcl(spark, sf).join(t, "day_id")
    fs = F.col("first_fried_kg") + F.col("second_fried_kg")
    plus = F.coalesce(F.col("plus_kg"), F.lit(0.0))
    return j.select("day_id", rnd(fs, 2).alias("total_fried"), rnd(F.col("end_g") / 1000, 2).alias("end_amount"),
                    rnd(F.col("sum_g") / 1000 - plus, 2).alias("amount_kg"),
                    rnd(fs - ((F.col("end_g") + F.col("sum_g")) / 1000 - plus), 1).alias("ex_fried_kg"))


_DESC = """
dsrc AS (SELECT store_id, day_of_week AS grp, sum_g FROM h1 UNION ALL SELECT store_id, 'ALL', sum_g FROM h1)"""


def _r6(x):
    return R(x, 6)


@register("agg_describe", sql((*H1_CTES, _DESC), f"""
SELECT store_id, grp AS day_of_week, COUNT(sum_g) AS count, {_r6('AVG(sum_g)')} AS mean, {_r6('STDDEV_SAMP(sum_g)')} AS std,
       CAST(MIN(sum_g) AS DOUBLE) AS min, {_r6('quantile_cont(sum_g, 0.25)')} AS p25, {_r6('quantile_cont(sum_g, 0.5)')} AS p50,
       {_r6('quantile_cont(sum_g, 0.75)')} AS p75, CAST(MAX(sum_g) AS DOUBLE) AS max
FROM dsrc WHERE sum_g IS NOT NULL GROUP BY store_id, grp"""))
def agg_describe(spark, sf):
    return describe.describe(describe.with_all_group(T.h1(spark, sf), "day_of_week"), "sum_g", [*STORE, "day_of_week"])


@register("agg_quantile", sql((*H1_CTES, _Q), "SELECT store_id, " + ", ".join(
    f"{R(c, 6)} AS {c}" for c in ("q1", "q3", "iqr", "lower", "upper")) + " FROM fence2"))
def agg_quantile(spark, sf):
    q = describe.quartiles(T.h1(spark, sf), "sum_g", STORE)
    return q.select(*STORE, *[rnd(F.col(c), 6).alias(c) for c in ("q1", "q3", "iqr", "lower", "upper")])


@register("agg_box_summary", sql((*H1_CTES, """
bq AS (
    SELECT store_id, day_of_week, quantile_cont(sum_g, 0.25) AS q1, quantile_cont(sum_g, 0.75) AS q3 FROM h1
    WHERE sum_g IS NOT NULL GROUP BY 1, 2
),
bf AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM bq)"""), f"""
SELECT h.store_id, h.day_of_week, CAST(MIN(h.sum_g) AS DOUBLE) AS min, {_r6('f.q1')} AS q1,
       {_r6('quantile_cont(h.sum_g, 0.5)')} AS median, {_r6('f.q3')} AS q3, CAST(MAX(h.sum_g) AS DOUBLE) AS max,
       CAST(MIN(CASE WHEN h.sum_g BETWEEN f.lower AND f.upper THEN h.sum_g END) AS DOUBLE) AS whisker_low,
       CAST(MAX(CASE WHEN h.sum_g BETWEEN f.lower AND f.upper THEN h.sum_g END) AS DOUBLE) AS whisker_high,
       CAST(SUM(CASE WHEN h.sum_g BETWEEN f.lower AND f.upper THEN 0 ELSE 1 END) AS BIGINT) AS n_outliers
FROM h1 h JOIN bf f ON h.store_id = f.store_id AND h.day_of_week = f.day_of_week
WHERE h.sum_g IS NOT NULL
GROUP BY h.store_id, h.day_of_week, f.q1, f.q3"""))
def agg_box_summary(spark, sf):
    return describe.box_summary(T.h1(spark, sf), "sum_g", [*STORE, "day_of_week"])


@register("agg_group_mean", sql(H1_CTES, f"""
SELECT store_id, is_pre_holiday AS day_status, {_r6('AVG(sum_g)')} AS mean FROM h1 GROUP BY 1, 2"""))
def agg_group_mean(spark, sf):
    h = T.h1(spark, sf).withColumnRenamed("is_pre_holiday", "day_status")
    return describe.group_mean(h, "sum_g", [*STORE, "day_status"])


@register("agg_group_sem", sql(H1_CTES, f"""
SELECT store_id, is_pre_holiday AS day_status, COUNT(sum_g) AS n, {_r6('AVG(sum_g)')} AS mean,
       {_r6('STDDEV_SAMP(sum_g)')} AS std, {_r6('STDDEV_SAMP(sum_g) / SQRT(COUNT(sum_g))')} AS sem
FROM h1 WHERE sum_g IS NOT NULL GROUP BY 1, 2"""))
def agg_group_sem(spark, sf):
    h = T.h1(spark, sf).withColumnRenamed("is_pre_holiday", "day_status")
    return describe.group_sem(h, "sum_g", [*STORE, "day_status"])


@register("agg_distinct_levels", sql(H1_CTES, "SELECT DISTINCT store_id, is_pre_holiday AS day_status FROM h1"))
def agg_distinct_levels(spark, sf):
    return T.h1(spark, sf).select("store_id", F.col("is_pre_holiday").alias("day_status")).distinct()


@register("agg_sample_size", sql(AF_CTES, f"""
SELECT store_id, COUNT(*) AS n_all, CAST(SUM(dow_tue) AS BIGINT) AS n_tue, CAST(SUM(1 - dow_tue) AS BIGINT) AS n_mon_fri,
       {_r6(f'AVG({T2})')} AS mean_t2, {_r6(f'STDDEV_SAMP({T2})')} AS std_t2
FROM af GROUP BY store_id"""))
def agg_sample_size(spark, sf):
    return af(spark, sf).groupBy("store_id").agg(
        F.count(F.lit(1)).alias("n_all"), F.sum("dow_tue").cast("long").alias("n_tue"),
        F.sum(1 - F.col("dow_tue")).cast("long").alias("n_mon_fri"),
        rnd(F.avg(T2), 6).alias("mean_t2"), rnd(F.stddev_samp(T2), 6).alias("std_t2"))


# ------------------------------------------------------------------ windows

_WIN = {
    "win_lag_prev": ["lag_prev_day_t1", "lag_prev_day_t2"],
    "win_lag_same": ["lag_same_day_t1", "lag_same_day_t2"],
    "win_lag_biweekly": ["lag_biweekly_t1", "lag_biweekly_t2"],
    "win_roll_prev3": ["roll_prev_3days_mean_t1", "roll_prev_3days_mean_t2"],
    "win_roll_same3": ["roll_same_3days_mean_t1", "roll_same_3days_mean_t2"],
    "win_roll_prev5": ["roll_prev_5days_mean_t1", "roll_prev_5days_mean_t2"],
    "win_lag_ratio_prev": ["lag_prev_t1_ratio", "lag_prev_t2_ratio"],
    "win_lag_ratio_same": ["lag_same_t1_ratio", "lag_same_t2_ratio"],
    "win_prev_total": ["prev_sum_g", "same_prev_sum_g"],
}


def _win_query(cols):
    def run(spark, sf):
        return T.mf(spark, sf).select("day_id", *cols)
    return run


for _name, _cols in _WIN.items():
    register(_name, sql(FEATURE_CTES, f"SELECT day_id, {', '.join(_cols)} FROM mf"))(_win_query(_cols))


@register("win_day_total", sql((), f"""
SELECT day_id, order_id, CAST(SUM({DEC}) OVER (PARTITION BY day_id) AS DOUBLE) AS day_total_g FROM odl"""))
def win_day_total(spark, sf):
    return peaks.with_day_total(T.odl(spark, sf)).select("day_id", "order_id", "day_total_g")


@register("win_share", sql((_SHARE,), "SELECT day_id, hh_mm, total, pct FROM share"))
def win_share(spark, sf):
    return _share(spark, sf).select("day_id", "hh_mm", "total", "pct")


@register("win_running", sql((), f"""
SELECT day_id, hh_mm, CAST(SUM(cb) OVER (PARTITION BY day_id ORDER BY hh_mm) AS DOUBLE) AS running_g
FROM (SELECT day_id, {BIN30_SQL} AS hh_mm, SUM({DEC}) AS cb FROM odl GROUP BY 1, 2) b"""))
def win_running(spark, sf):
    from pyspark.sql import Window

    s = peaks.bin_sums(T.odl(spark, sf), "hh_mm", 30)
    return s.select("day_id", "hh_mm", from_units(F.sum("cum_units").over(Window.partitionBy("day_id").orderBy("hh_mm")))
                    .alias("running_g"))


@register("win_cum_share", sql((_SHARE,), "SELECT day_id, hh_mm, cum_pct FROM share"))
def win_cum_share(spark, sf):
    return _share(spark, sf).select("day_id", "hh_mm", "cum_pct")


# ------------------------------------------------------------------ ordering


@register("ord_output", sql(FEATURE_CTES, f"""
SELECT day_id, store_id, date, cumul_20_22 FROM mf WHERE date >= DATE '{VALIDATION_START}' ORDER BY store_id, date"""))
def ord_output(spark, sf):
    mf = T.mf(spark, sf)
    return mf.filter(F.col("date") >= F.lit(VALIDATION_START).cast("date")).select(
        "day_id", "store_id", "date", T2).orderBy("store_id", "date")


@register("ord_by_date", sql(AF_CTES, f"SELECT store_id, date, {T1} FROM af ORDER BY store_id, date"))
def ord_by_date(spark, sf):
    return af(spark, sf).select("store_id", "date", T1).orderBy("store_id", "date")


@register("top_head", sql(FEATURE_CTES, f"""
SELECT day_id, store_id, date, day_of_week, cumul_20_22, roll_prev_3days_mean_t2 FROM mf
WHERE date >= DATE '{VALIDATION_START}' AND date < DATE '{VALIDATION_END}' ORDER BY store_id, date LIMIT 5"""))
def top_head(spark, sf):
    """Preview: the first five rows in an explicit order (the limit is the feature)."""
    return features.validation_set(T.mf(spark, sf), VALIDATION_START, VALIDATION_END).limit(5)


# ------------------------------------------------------------------ sources and sinks

_ODL_COLS = "day_id, store_id, order_id, receipt_id, order_datetime, order_date, qty, amount_g"


@register("src_detail_csv", sql((), f"SELECT {_ODL_COLS} FROM odl"))
def src_detail_csv(spark, sf):
    path = scratch_path(spark, "order_lines_csv")
    logs.write_csv(T.odl(spark, sf), path)
    ok, _ = logs.load_order_lines(spark, path)
    return ok


@register("src_daily_csv", sql((), "SELECT * FROM dcl"))
def src_daily_csv(spark, sf):
    path = scratch_path(spark, "daily_log_csv")
    logs.write_csv(T.dcl(spark, sf), path)
    ok, _ = logs.load_daily_log(spark, path)
    return ok


@register("src_typed_schema", sql((), """
SELECT 'accepted' AS status, COUNT(*) AS n_rows FROM odl WHERE day_id IS NOT NULL AND order_id IS NOT NULL
UNION ALL
SELECT 'quarantined', COUNT(*) FROM odl WHERE day_id IS NULL OR order_id IS NULL"""))
def src_typed_schema(spark, sf):
    path = scratch_path(spark, "order_lines_typed")
    logs.write_csv(T.odl(spark, sf), path)
    ok, bad = logs.load_order_lines(spark, path)

    def cnt(df, status):
        return df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(status).alias("status"), "n_rows")

    return cnt(ok, "accepted").unionByName(cnt(bad, "quarantined"))


# The export files as they come: ten and 21 columns by position, textual order ids, and lines that can't be loaded.
_FILE_ROWS = """
files AS (
    SELECT CASE WHEN order_id % 89 = 0 THEN NULL ELSE day_id END AS day_id, 'ORD' || order_id AS order_id, receipt_id, order_datetime,
           CASE WHEN order_id % 2 = 0 THEN 'hall' END AS channel, 'log, ' || CAST(order_date AS VARCHAR) || '.csv' AS source_file,
           'set "' || (qty + 1) || '", large' AS menu_name, CASE qty WHEN 1 THEN 'S' WHEN 2 THEN 'M' ELSE 'L' END AS size_category, qty, amount_g,
           order_id % 97 = 0 AS broken
    FROM odl
)"""


def _order_file(spark, sf):
    """Write the order lines as an export file: keys missing in one line of 89, an unreadable quantity in one of 97."""
    o, n = T.odl(spark, sf), F.col("order_id")
    rows = o.select(
        F.when(n % 89 != 0, F.col("day_id")).alias("day_id"), F.concat(F.lit("ORD"), n).alias("order_id"), "receipt_id", "order_datetime",
        F.when(n % 2 == 0, F.lit("hall")).alias("channel"), F.concat(F.lit("log, "), F.col("order_date").cast("string"), F.lit(".csv")).alias("source_file"),
        F.concat(F.lit('set "'), (F.col("qty") + 1).cast("string"), F.lit('", large')).alias("menu_name"),
        F.when(F.col("qty") == 1, "S").when(F.col("qty") == 2, "M").otherwise("L").alias("size_category"),
        F.when(n % 97 == 0, F.lit("two")).otherwise(F.col("qty").cast("string")).alias("qty"), "amount_g")
    path = scratch_path(spark, "order_file")
    logs.write_csv(rows, path)
    return path


@register("src_order_file", sql((_FILE_ROWS,), """
SELECT day_id, order_id, receipt_id, order_datetime, channel, source_file, menu_name, size_category, qty, amount_g
FROM files WHERE NOT broken AND day_id IS NOT NULL"""))
def src_order_file(spark, sf):
    """Accepted lines of the ten-column order file, quoted commas and quotes included."""
    return logs.load_order_file(spark, _order_file(spark, sf))[0]


@register("src_order_file_status", sql((_FILE_ROWS,), """
SELECT CASE WHEN broken THEN 'malformed' WHEN day_id IS NULL THEN 'missing key' ELSE 'accepted' END AS status, COUNT(*) AS n_rows
FROM files GROUP BY 1"""))
def src_order_file_status(spark, sf):
    """How many lines of the order file were accepted, and why the others were not."""
    ok, bad = logs.load_order_file(spark, _order_file(spark, sf))
    why = F.when(F.col(logs.CORRUPT).isNotNull(), F.lit("malformed")).otherwise(F.lit("missing key"))
    both = ok.select(F.lit("accepted").alias("status")).unionByName(bad.select(why.alias("status")))
    return both.groupBy("status").agg(F.count(F.lit(1)).alias("n_rows"))


@register("src_daily_file", sql((), "SELECT * EXCLUDE (store_id) FROM dcl WHERE dayofmonth(date) <> 13"))
def src_daily_file(spark, sf):
    """Accepted rows of the 21-column daily file; the rows of one date come without their key."""
    rows = T.dcl(spark, sf).drop("store_id").withColumn("day_id", F.when(F.dayofmonth("date") != 13, F.col("day_id")))
    path = scratch_path(spark, "daily_file")
    logs.write_csv(rows, path)
    return logs.load_daily_file(spark, path)[0]


@register("sink_overwrite", sql((DAYT,), f"SELECT day_id, {R('sum_g / 1000', 2)} AS amount_kg FROM dayt"))
def sink_overwrite(spark, sf):
    path = scratch_path(spark, "daily_kg")
    for _ in range(2):  # the second run replaces, never appends; parent and child become visible together
        publish({"daily_log": T.dcl(spark, sf), "daily_kg": kpi.daily_kg(T.odl(spark, sf))}, path)
    days = published(spark, path, "daily_log").select("day_id")
    return published(spark, path, "daily_kg").join(days, "day_id", "left_semi")


@register("src_snapshot", sql(FEATURE_CTES, "SELECT * FROM mf"))
def src_snapshot(spark, sf):
    path = scratch_path(spark, "model_feature")
    logs.write_snapshot(T.mf(spark, sf), path)
    return logs.read_snapshot(spark, path)


@register("sink_dashboard", sql((), f"""
SELECT day_id, hh_mm, pct, daily_peak_pct, daily_2peek_pct FROM (
    SELECT *, {R('AVG(pct) OVER (PARTITION BY day_id) + STDDEV_POP(pct) OVER (PARTITION BY day_id)', 2)} AS daily_peak_pct,
              {R('AVG(pct) OVER (PARTITION BY day_id) + 2 * STDDEV_POP(pct) OVER (PARTITION BY day_id)', 2)} AS daily_2peek_pct
    FROM (SELECT day_id, hh_mm, {R(D('cb', 'SUM(cb) OVER (PARTITION BY day_id)') + ' * 100', 2)} AS pct
          FROM (SELECT day_id, {BIN30_SQL} AS hh_mm, SUM({DEC}) AS cb FROM odl GROUP BY 1, 2) b) s
) t WHERE pct > daily_peak_pct"""))
def sink_dashboard(spark, sf):
    """Peak table published for dashboards, partitioned by date for pruning."""
    path = scratch_path(spark, "peak30")
    out = peaks.peak30(T.odl(spark, sf)).withColumn("date", F.to_date(F.substring("day_id", -10, 10)))
    replace_dates(out, path)
    replace_dates(out.where(F.dayofmonth("date") <= 5), path)  # a later run of some days rewrites those only
    return logs.read_snapshot(spark, path).drop("date")



_MODEL_SQL_COLS = ("const", "dow_fri", "roll_prev_3days_mean_t2")


@register("model_save", sql((*AF_CTES, _ols2("af", T2, "dow_fri", "roll_prev_3days_mean_t2")), "\nUNION ALL\n".join(
    f"SELECT store_id, 't2' AS model, '{term}' AS term, {R(b, 4)} AS coef, {R(se, 4)} AS se, {R(f'{b} / NULLIF({se}, 0)', 4)} AS t FROM o2"
    for term, b, se in (("const", "b0", "se0"), ("dow_fri", "b1", "se1"), ("roll_prev_3days_mean_t2", "b2", "se2")))))
def model_save(spark, sf):
    """Fit the T2 model per store and persist its coefficient table; returns what was written."""
    from prepcast.operators import regression
    from prepcast.plans.q_model import T2_MODEL

    coef, _ = regression.ols_tables(regression.model_grams(af(spark, sf), {"t2": T2_MODEL}, T2, STORE), STORE)
    path = scratch_path(spark, "model_t2")
    logs.save_model(coef, path)
    return logs.load_model(spark, path).select(
        "store_id", "model", "term", *[rnd(F.col(x), 4).alias(x) for x in ("coef", "se", "t")])


@register("model_load", sql((*AF_CTES, _cramer("af", T2, "dow_fri", "roll_prev_3days_mean_t2")), f"""
SELECT a.store_id, a.day_id, {R('c.b0 + c.b1 * a.dow_fri + c.b2 * a.roll_prev_3days_mean_t2', 4)} AS prediction
FROM af a LEFT JOIN coef2 c ON a.store_id = c.store_id WHERE a.date >= DATE '{VALIDATION_START}'"""))
def model_load(spark, sf):
    """Round trip: save the coefficient table, load it back and score the validation days with it."""
    from prepcast.operators import regression
    from prepcast.plans.q_model import T2_MODEL

    coef, _ = regression.ols_tables(regression.model_grams(af(spark, sf), {"t2": T2_MODEL}, T2, STORE), STORE)
    path = scratch_path(spark, "model_t2")
    logs.save_model(coef, path)
    loaded = logs.load_model(spark, path, "t2")
    valid = af(spark, sf).filter(F.col("date") >= F.lit(VALIDATION_START).cast("date"))
    return regression.predict(valid, loaded, STORE, "t2", T2_MODEL).select(
        "store_id", "day_id", F.round("prediction", 4).alias("prediction"))


# ------------------------------------------------------------------ streaming


@register("stream_bin30", sql((), f"""
SELECT store_id, time_bucket(INTERVAL 30 MINUTE, order_datetime) AS bin_start,
       CAST(SUM({DEC}) AS DOUBLE) AS amount_g, COUNT(*) AS n_lines
FROM odl GROUP BY 1, 2"""))
def stream_bin30(spark, sf):
    """The order-line file stream folded into the half-hour bin table (all available data)."""
    from prepcast.streaming.bins_stream import run_available

    return run_available(spark, sf, file_glob="events.parquet")


# ------------------------------------------------------------------ scalar functions (§2.9)


@register("fn_date_format", sql((), "SELECT order_id, strftime(order_datetime, '%H:') AS hh, "
                                    "strftime(order_datetime, '%H:00') AS hh00 FROM odl"))
def fn_date_format(spark, sf):
    ts = F.col("order_datetime")
    return T.odl(spark, sf).select("order_id", F.date_format(ts, "HH:").alias("hh"), F.date_format(ts, "HH:00").alias("hh00"))


@register("fn_minute_floor", sql((), "SELECT order_id, CAST(minute(order_datetime) AS INTEGER) AS minute, "
                                     "CAST(floor(minute(order_datetime) / 30) * 30 AS BIGINT) AS half FROM odl"))
def fn_minute_floor(spark, sf):
    ts = F.col("order_datetime")
    return T.odl(spark, sf).select("order_id", F.minute(ts).alias("minute"),
                                   (F.floor(F.minute(ts) / 30) * 30).cast("long").alias("half"))


@register("fn_lpad_concat", sql((), f"SELECT order_id, {BIN30_SQL} AS hh_mm, lpad(CAST(qty AS VARCHAR), 3, '0') AS qty3 FROM odl"))
def fn_lpad_concat(spark, sf):
    return T.odl(spark, sf).select("order_id", bin30(F.col("order_datetime")).alias("hh_mm"),
                                   F.lpad(F.col("qty").cast("string"), 3, "0").alias("qty3"))


@register("fn_round", sql((), f"SELECT day_id, {R('end_g / 1000', 2)} AS end_kg2, {R('end_g / 1000', 1)} AS end_kg1 FROM dcl"))
def fn_round(spark, sf):
    return T.dcl(spark, sf).select("day_id", rnd(F.col("end_g") / 1000, 2).alias("end_kg2"),
                                   rnd(F.col("end_g") / 1000, 1).alias("end_kg1"))


@register("fn_round_half_even", sql((), "SELECT order_id, round_even(amount_g / 10, 0) AS amount_dag FROM odl"))
def fn_round_half_even(spark, sf):
    from prepcast.functions.columns import rnd_even

    return T.odl(spark, sf).select("order_id", rnd_even(F.col("amount_g") / 10, 0).alias("amount_dag"))


@register("fn_coalesce", sql((), "SELECT day_id, COALESCE(second_fried_kg, 0) AS second_fried_kg FROM dcl"))
def fn_coalesce(spark, sf):
    return T.dcl(spark, sf).select("day_id", F.coalesce(F.col("second_fried_kg"), F.lit(0.0)).alias("second_fried_kg"))


@register("fn_abs", sql(AF_CTES, f"SELECT day_id, abs(roll_prev_3days_mean_t2 - {T2}) AS abs_gap FROM af"))
def fn_abs(spark, sf):
    return af(spark, sf).select("day_id", F.abs(F.col("roll_prev_3days_mean_t2") - F.col(T2)).alias("abs_gap"))


@register("fn_case_searched", sql((), f"SELECT day_id, {HOLIDAY} AS holiday_status, "
                                      "CASE WHEN second_fried_kg IS NULL THEN 'single' WHEN second_fried_kg > first_fried_kg "
                                      "THEN 'second_larger' ELSE 'first_larger' END AS batches FROM dcl"))
def fn_case_searched(spark, sf):
    d = T.dcl(spark, sf)
    return d.select("day_id", holiday_flag(F.col("is_holiday"), F.col("is_pre_holiday")).alias("holiday_status"),
                    F.when(F.col("second_fried_kg").isNull(), "single")
                    .when(F.col("second_fried_kg") > F.col("first_fried_kg"), "second_larger")
                    .otherwise("first_larger").alias("batches"))


@register("fn_case_simple", sql((), f"SELECT day_id, CASE day_of_week WHEN '{FRI}' THEN 'pre_weekend' "
                                    f"WHEN '{THU}' THEN 'excluded' ELSE 'regular' END AS day_kind FROM dcl"))
def fn_case_simple(spark, sf):
    dow = F.col("day_of_week")
    return T.dcl(spark, sf).select("day_id", F.when(dow == FRI, "pre_weekend").when(dow == THU, "excluded")
                                   .otherwise("regular").alias("day_kind"))


@register("fn_like_date", sql(FEATURE_CTES, f"""
SELECT day_id, date FROM mf WHERE date >= DATE '{MONTH}-01' AND date < DATE '{MONTH}-01' + INTERVAL 1 MONTH"""))
def fn_like_date(spark, sf):
    """``date LIKE 'YYYY-MM%'`` as a half-open range on the date."""
    return features.month_filter(T.mf(spark, sf), MONTH).select("day_id", "date")


@register("fn_division", sql((DAYT,), f"""
SELECT d.day_id, {R(D('t.sum_g / 1000', '(d.first_fried_kg + d.second_fried_kg)'), 4)} AS demand_per_stock
FROM dcl d JOIN dayt t ON d.day_id = t.day_id"""))
def fn_division(spark, sf):
    """Division with NULL on a zero (or NULL) divisor."""
    from prepcast.functions.columns import div

    t = daily.day_totals(T.odl(spark, sf), ["day_id"])
    j = T.dcl(spark, sf).join(t, "day_id")
    return j.select("day_id", rnd(div(F.col("sum_g") / 1000, F.col("first_fried_kg") + F.col("second_fried_kg")), 4)
                    .alias("demand_per_stock"))


@register("fn_date_add", sql(FEATURE_CTES, "SELECT day_id, CAST(date + INTERVAL 7 DAY AS DATE) AS date_plus_7 FROM mf"))
def fn_date_add(spark, sf):
    return T.mf(spark, sf).select("day_id", F.date_add("date", 7).alias("date_plus_7"))


@register("fn_to_date", sql((), "SELECT order_id, CAST(order_datetime AS DATE) AS order_day FROM odl"))
def fn_to_date(spark, sf):
    return T.odl(spark, sf).select("order_id", F.to_date("order_datetime").alias("order_day"))


@register("fn_sqrt_mean_square", sql(AF_CTES, f"""
SELECT store_id, {R(f'sqrt(AVG((roll_prev_3days_mean_t2 - {T2}) * (roll_prev_3days_mean_t2 - {T2})))', 4)} AS rms_gap
FROM af GROUP BY store_id"""))
def fn_sqrt_mean_square(spark, sf):
    gap = F.col("roll_prev_3days_mean_t2") - F.col(T2)
    return af(spark, sf).groupBy("store_id").agg(rnd(F.sqrt(F.avg(gap * gap)), 4).alias("rms_gap"))


@register("fn_bool_and_mean", sql(AF_CTES, f"""
SELECT store_id, {R(f'AVG(CAST((dow_fri = 1 AND {T2} > roll_prev_3days_mean_t2) AS INTEGER))', 4)} AS share_fri_above
FROM af WHERE roll_prev_3days_mean_t2 IS NOT NULL GROUP BY store_id"""))
def fn_bool_and_mean(spark, sf):
    a = af(spark, sf).filter(F.col("roll_prev_3days_mean_t2").isNotNull())
    flag = (F.col("dow_fri") == 1) & (F.col(T2) > F.col("roll_prev_3days_mean_t2"))
    return a.groupBy("store_id").agg(rnd(F.avg(flag.cast("int")), 4).alias("share_fri_above"))
