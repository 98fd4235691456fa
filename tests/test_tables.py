"""Table operators: edge cases, leakage, plan shape."""

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from prepcast.operators import daily, features, kpi, peaks, quality
from prepcast.plans import tables as T

from tests.paths import SF_SMALL


def _odl(spark, rows):
    pdf = pd.DataFrame(rows, columns=["day_id", "store_id", "order_id", "order_datetime", "qty", "amount_g"])
    pdf["order_datetime"] = pd.to_datetime(pdf["order_datetime"])
    return spark.createDataFrame(pdf).withColumn("order_datetime", F.col("order_datetime").cast("timestamp_ntz"))


def _dcl(spark, rows):
    cols = ["day_id", "store_id", "date", "day_of_week", "is_holiday", "is_pre_holiday", "first_fried_kg",
            "second_fried_kg", "end_g", "plus_kg"]
    schema = ("day_id string, store_id string, date date, day_of_week string, is_holiday int, is_pre_holiday int, "
              "first_fried_kg double, second_fried_kg double, end_g double, plus_kg double")
    return spark.createDataFrame([tuple(r) for r in rows], schema=schema).select(*cols)


def test_bins_and_pivot_zero_fill(spark):
    odl = _odl(spark, [
        ("d1", "s", 1, "2024-01-01 16:10:00", 1, 100.0),
        ("d1", "s", 2, "2024-01-01 16:40:00", 2, 50.0),
        ("d1", "s", 3, "2024-01-01 23:10:00", 1, 7.0),   # outside every bin, still in sum_g
    ])
    p = daily.pivot_bins(odl).collect()[0]
    assert p["16:00"] == 100.0 and p["16:30"] == 50.0 and p["22:30"] == 0.0
    assert p["sum_g"] == 157.0 and p["cnt"] == 4


def test_single_bin_day_has_no_peak(spark):
    odl = _odl(spark, [("d1", "s", 1, "2024-01-01 18:05:00", 1, 10.0), ("d1", "s", 2, "2024-01-01 18:20:00", 1, 5.0)])
    assert peaks.peak30(odl).count() == 0


def test_utilisation_cases_and_nulls(spark):
    dcl = _dcl(spark, [
        ("d1", "s", dt.date(2024, 1, 1), "월", 0, 0, 1.0, 1.0, 500.0, None),   # demand > stock -> carry-over
        ("d2", "s", dt.date(2024, 1, 2), "화", 0, 0, 9.0, None, 500.0, 0.5),   # NULL second batch
        ("d3", "s", dt.date(2024, 1, 3), "수", 0, 0, 0.0, 0.0, 0.0, None),     # zero stock -> NULL rate
    ])
    odl = _odl(spark, [("d1", "s", 1, "2024-01-01 17:00:00", 1, 3000.0),
                       ("d2", "s", 1, "2024-01-02 17:00:00", 1, 1000.0),
                       ("d3", "s", 1, "2024-01-03 17:00:00", 1, 0.0)])
    out = {r["day_id"]: r for r in kpi.utilisation(odl, dcl).collect()}
    assert out["d1"]["pre_fried_kg"] == 1.5 and out["d1"]["total_pre_kg"] == 3.5
    assert out["d1"]["using_rate"] == round(3.0 / 3.5, 2)
    assert out["d2"]["total_fried"] is None and out["d2"]["using_rate"] is None
    assert out["d3"]["using_rate"] is None


def test_orphans_and_duplicates(spark):
    dcl = _dcl(spark, [("d1", "s", dt.date(2024, 1, 1), "월", 0, 0, 1.0, 1.0, 0.0, None)])
    odl = _odl(spark, [("d1", "s", 1, "2024-01-01 17:00:00", 1, 1.0), ("d1", "s", 1, "2024-01-01 17:00:00", 1, 1.0),
                       ("d9", "s", 2, "2024-01-09 17:00:00", 1, 1.0)])
    assert [r["day_id"] for r in quality.orphans(odl, dcl).collect()] == ["d9"]
    v = quality.key_violations(odl, ["day_id", "order_id"]).collect()
    assert len(v) == 1 and v[0]["n_rows"] == 2


def test_features_do_not_leak_current_day(spark):
    tt = T.tt(spark, SF_SMALL)
    base = features.model_feature(tt).filter(F.col("store_id") == "click").orderBy("date").collect()
    target_day = base[10]["day_id"]
    bumped = tt.withColumn("16:00", F.when(F.col("day_id") == target_day, F.col("`16:00`") + 1e6).otherwise(F.col("`16:00`")))
    again = {r["day_id"]: r for r in features.model_feature(bumped).filter(F.col("store_id") == "click").collect()}
    for col in features.FEATURE_COLUMNS:
        assert again[target_day][col] == base[10][col], col


def test_rolling_mean_needs_full_window(spark):
    mf = features.model_feature(T.tt(spark, SF_SMALL)).filter(F.col("store_id") == "view").orderBy("date").collect()
    assert all(r["roll_prev_5days_mean_t1"] is None for r in mf[:5])
    assert mf[5]["roll_prev_5days_mean_t1"] == round(sum(r["cumul_16_19"] for r in mf[:5]) / 5, 2)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pivot_is_one_aggregation_exchange(spark):
    plan = _plan(daily.pivot_bins(T.odl(spark, SF_SMALL)))
    assert plan.count("Exchange hashpartitioning") <= 1
    assert "Pivot" not in plan


def test_peaks_plan_has_no_join_and_no_python(spark):
    plan = _plan(peaks.peak30(T.odl(spark, SF_SMALL)))
    assert "Join" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan


def test_scan_prunes_columns(spark):
    df = daily.day_totals(T.odl(spark, SF_SMALL), ["day_id"])
    plan = _plan(df)
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,props:string,value:double>" in plan or \
        "ReadSchema" in plan and "user_id" not in plan.split("ReadSchema")[1].split("\n")[0]


@pytest.mark.parametrize("name", ["q_peak30", "q_base_daily", "q_utilisation", "st_ttest_rel", "reg_coefficients"])
def test_registered_queries_match_duckdb_small(spark, name):
    import duckdb

    import __spark_entry__ as E

    con = duckdb.connect()
    for t in ("events", "lineitem", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    sdf = E.queries()[name](spark, SF_SMALL)
    cur = con.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(cols) == sorted(sdf.columns)

    def norm(rows):
        return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in rows)

    assert norm([tuple(r[c] for c in cols) for r in sdf.collect()]) == norm(cur.fetchall())


def test_row_level_day_total_is_not_a_window_over_order_lines(spark):
    plan = _plan(peaks.row_bins(T.odl(spark, SF_SMALL)))
    assert "Window" not in plan
    assert "HashAggregate" in plan


def test_keep_first_is_deterministic(spark):
    df = spark.createDataFrame([("k", 3, "c"), ("k", 1, "b"), ("k", 1, "a"), ("j", 5, "z")], "key string, o int, v string")
    out = {r["key"]: (r["o"], r["v"]) for r in quality.keep_first(df, ["key"], [F.col("o")]).collect()}
    assert out == {"k": (1, "a"), "j": (5, "z")}


def test_rank_tests_run_without_python(spark):
    from prepcast.operators import stats

    h3 = features.stage_targets(T.tt(spark, SF_SMALL))
    for df in (stats.shapiro(h3, "sum_g", ["store_id"]),
               stats.wilcoxon(h3, "cumul_16_19", "cumul_20_22", ["store_id"], with_p=True, buckets=4)):
        plan = _plan(df)
        assert "Python" not in plan and "ArrowEval" not in plan


def test_day_shares_sum_to_100(spark):
    share = peaks.share_table(T.odl(spark, SF_SMALL))
    sums = share.groupBy("day_id").agg(F.sum("pct").alias("s"), F.count(F.lit(1)).alias("k")).collect()
    for r in sums:
        assert abs(r["s"] - 100.0) <= 0.005 * r["k"] + 1e-9


def test_null_weekday_is_dropped_by_exclusion(spark):
    df = spark.createDataFrame([("a", "목"), ("b", None), ("c", "월")], "day_id string, day_of_week string")
    assert [r["day_id"] for r in features.exclude_weekday(df).collect()] == ["c"]


def test_constant_feature_has_null_correlation(spark):
    from prepcast.operators import corr

    df = spark.createDataFrame([("g", 1.0, 5.0), ("g", 2.0, 5.0), ("g", 3.0, 5.0)], "grp string, y double, x double")
    r = corr.corr_target(df, ["x", "y"], "y", ["grp"]).collect()
    got = {row["feature"]: row["r"] for row in r}
    assert got["x"] is None and abs(got["y"] - 1.0) < 1e-9
