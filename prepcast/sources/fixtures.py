"""Driver tables -> the two operational logs the analytics run on.

The analytics work on an order-line log (one row per receipt line, N per
store-day) and a daily operations log (one row per store-day). The driver
ships neither, so both are derived from ``events`` by the fixed rules below
(see FIXTURES.md). Every rule uses integer arithmetic or exact decimal sums so
that Spark and the DuckDB oracle build identical inputs.

* order lines: ``store_id`` = event_type, ``order_id`` = event_id,
  ``receipt_id`` = user_id, ``order_datetime`` = ts, ``qty`` = k % 3 + 1
  (k = the integer in ``props``), ``amount_g`` = value.
* daily log: one row per (store_id, date) that has order lines; preparation
  amounts are fractions of that day's demand, the fraction driven by k.

In production the daily log is a small table of its own (one row per
store-day); here it costs one extra aggregation over the order lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepcast.functions.columns import weekday_label


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def order_lines(spark: SparkSession, sf_dir: str, store_col: str = "event_type") -> DataFrame:
    """Order-line log: one row per receipt line, N per store-day.

    ``store_col`` picks the events column that plays the store (``user_id``
    gives the many-entity variant used by the scale test).
    """
    ev = _events(spark, sf_dir)
    order_date = F.to_date("ts")
    store = F.col(store_col).cast("string")
    return ev.select(
        F.concat(store, F.lit("_"), order_date.cast("string")).alias("day_id"),
        store.alias("store_id"),
        F.col("event_id").alias("order_id"),
        F.col("user_id").cast("string").alias("receipt_id"),
        F.col("ts").alias("order_datetime"),
        order_date.alias("order_date"),
        (F.regexp_extract("props", r"([0-9]+)", 1).try_cast("int") % 3 + 1).alias("qty"),
        F.col("value").alias("amount_g"),
    )


def daily_log(spark: SparkSession, sf_dir: str, store_col: str = "event_type") -> DataFrame:
    """Daily operations log: one row per store-day (preparation amounts, leftovers, flags)."""
    k = F.regexp_extract(F.col("props"), r"([0-9]+)", 1).try_cast("long")
    ev = _events(spark, sf_dir).select(
        F.col(store_col).cast("string").alias("store_id"),
        F.to_date("ts").alias("date"),
        F.hour("ts").alias("hh"),
        F.col("ts"),
        k.alias("k"),
        F.round(F.col("value") * 100).cast("long").alias("cents"),
    )
    day = ev.groupBy("store_id", "date").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cents").alias("cents"),
        F.sum("k").alias("ksum"),
        F.max("k").alias("kmax"),
        F.min("k").alias("kmin"),
        F.sum(F.when(F.col("hh") >= 19, 1).otherwise(0)).alias("late"),
        F.min(F.when(F.col("hh") >= 19, F.col("ts"))).alias("first_late_ts"),
        F.max("ts").alias("last_ts"),
    )
    dow = F.weekday("date") + 1  # 1 = Monday
    first_c = F.expr("(cents * (60 + ksum % 31)) div 100000")
    second_c = F.expr("(cents * (25 + kmax % 21)) div 100000")

    def hundredths(x):
        return x.cast("double") / F.lit(100.0)

    late = F.col("late") > 0
    return day.select(
        F.concat(F.col("store_id"), F.lit("_"), F.col("date").cast("string")).alias("day_id"),
        "store_id",
        "date",
        weekday_label(F.col("date")).alias("day_of_week"),
        F.when(F.col("kmin") % 4 == 0, 1).otherwise(0).alias("is_rain"),
        F.when(F.col("n") % 13 == 0, F.lit(None)).when(dow >= 6, 1).otherwise(0).cast("int").alias("is_holiday"),
        F.when(dow >= 6, F.lit("1")).otherwise(F.lit("-")).alias("long_weekend"),
        F.lit(None).cast("string").alias("long_weekend_note"),
        F.when(dow == 5, 1).otherwise(0).alias("is_pre_holiday"),
        F.lit(None).cast("string").alias("special_day"),
        F.when(F.col("kmax") % 10 == 0, 1).otherwise(0).alias("is_substitute"),
        hundredths(F.expr("(cents * (60 + ksum % 31)) div 100000 * 100 div 88")).alias("first_raw_kg"),
        hundredths(first_c).alias("first_fried_kg"),
        F.when(late, 1).otherwise(0).alias("is_refried"),
        F.when(late, F.expr("cents * (kmin % 5) div 1000").cast("double")).alias("pre_refry_left_g"),
        F.date_format("first_late_ts", "HH:mm:ss").alias("refry_time"),
        F.when(late, hundredths(F.expr("(cents * (25 + kmax % 21)) div 100000 * 100 div 88"))).alias("second_raw_kg"),
        F.when(late, hundredths(second_c)).alias("second_fried_kg"),
        F.expr("cents * (kmin % 9) div 1000").cast("double").alias("end_g"),
        F.date_format("last_ts", "HH:mm:ss").alias("close_time"),
        F.lit(None).cast("string").alias("remark"),
        F.when(F.dayofmonth("date") >= 15, (F.col("n") % 7).cast("double") / F.lit(10.0)).alias("plus_kg"),
    )


# DuckDB text of the same two tables, used as a prefix by every oracle query.
ORACLE_FIXTURE_CTE = """
odl AS (
    SELECT event_type || '_' || CAST(CAST(ts AS DATE) AS VARCHAR) AS day_id,
           event_type AS store_id,
           event_id AS order_id,
           CAST(user_id AS VARCHAR) AS receipt_id,
           ts AS order_datetime,
           CAST(ts AS DATE) AS order_date,
           TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) % 3 + 1 AS qty,
           value AS amount_g
    FROM events
),
dcl_src AS (
    SELECT event_type AS store_id, CAST(ts AS DATE) AS date,
           COUNT(*) AS n,
           SUM(CAST(round(value * 100) AS BIGINT)) AS cents,
           SUM(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS ksum,
           MAX(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS kmax,
           MIN(TRY_CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT)) AS kmin,
           SUM(CASE WHEN hour(ts) >= 19 THEN 1 ELSE 0 END) AS late,
           MIN(CASE WHEN hour(ts) >= 19 THEN ts END) AS first_late_ts,
           MAX(ts) AS last_ts
    FROM events
    GROUP BY 1, 2
),
dcl AS (
    SELECT store_id || '_' || CAST(date AS VARCHAR) AS day_id, store_id, date,
           list_extract(['월','화','수','목','금','토','일'], isodow(date)) AS day_of_week,
           CASE WHEN kmin % 4 = 0 THEN 1 ELSE 0 END AS is_rain,
           CAST(CASE WHEN n % 13 = 0 THEN NULL WHEN isodow(date) >= 6 THEN 1 ELSE 0 END AS INTEGER) AS is_holiday,
           CASE WHEN isodow(date) >= 6 THEN '1' ELSE '-' END AS long_weekend,
           CAST(NULL AS VARCHAR) AS long_weekend_note,
           CASE WHEN isodow(date) = 5 THEN 1 ELSE 0 END AS is_pre_holiday,
           CAST(NULL AS VARCHAR) AS special_day,
           CASE WHEN kmax % 10 = 0 THEN 1 ELSE 0 END AS is_substitute,
           CAST((cents * (60 + ksum % 31)) // 100000 * 100 // 88 AS DOUBLE) / 100.0 AS first_raw_kg,
           CAST((cents * (60 + ksum % 31)) // 100000 AS DOUBLE) / 100.0 AS first_fried_kg,
           CASE WHEN late > 0 THEN 1 ELSE 0 END AS is_refried,
           CASE WHEN late > 0 THEN CAST(cents * (kmin % 5) // 1000 AS DOUBLE) END AS pre_refry_left_g,
           strftime(first_late_ts, '%H:%M:%S') AS refry_time,
           CASE WHEN late > 0 THEN CAST((cents * (25 + kmax % 21)) // 100000 * 100 // 88 AS DOUBLE) / 100.0 END AS second_raw_kg,
           CASE WHEN late > 0 THEN CAST((cents * (25 + kmax % 21)) // 100000 AS DOUBLE) / 100.0 END AS second_fried_kg,
           CAST(cents * (kmin % 9) // 1000 AS DOUBLE) AS end_g,
           strftime(last_ts, '%H:%M:%S') AS close_time,
           CAST(NULL AS VARCHAR) AS remark,
           CASE WHEN dayofmonth(date) >= 15 THEN CAST(n % 7 AS DOUBLE) / 10.0 END AS plus_kg
    FROM dcl_src
)"""
