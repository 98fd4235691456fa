"""Daily tables: half-hour bins pivoted per day, joined to the daily log.

One aggregation (one shuffle) turns order lines into a day row: the 14 bin
sums are conditional sums inside the same ``agg`` as the totals, so no
``pivot`` (which would cost a second pass) and empty bins are 0.
The child is aggregated *before* the join, so the join sees one row per day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepcast.functions.columns import BINS30, bin30, bin30_index, bin30_slot, c, units, from_units, holiday_flag, rnd

DAY_KEYS = ["day_id", "store_id"]


def pivot_bins(odl: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per day: 14 half-hour sums, ``sum_g`` and ``cnt`` (= SUM(qty)) in one pass.

    Rows are matched to bins by an integer slot index (no per-row strings).
    """
    keys = keys or DAY_KEYS
    t = odl.select(*keys, bin30_index(F.col("order_datetime")).alias("_slot"), units(F.col("amount_g")).alias("_c"), "qty")
    sums = [
        from_units(F.sum(F.when(F.col("_slot") == bin30_slot(b), F.col("_c")).otherwise(F.lit(0).cast("long")))).alias(b)
        for b in BINS30
    ]
    return t.groupBy(*keys).agg(
        *sums,
        from_units(F.sum("_c")).alias("sum_g"),
        F.sum("qty").alias("cnt"),
    )


def day_totals(odl: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per day: exact ``sum_g`` (g) and ``cnt``; the pre-aggregated child of every join."""
    keys = keys or DAY_KEYS
    return odl.groupBy(*keys).agg(
        from_units(F.sum(units(F.col("amount_g")))).alias("sum_g"),
        F.sum("qty").alias("cnt"),
    )


def total_fired(dcl: DataFrame) -> Column:
    return rnd(F.col("first_fried_kg") + F.col("second_fried_kg"), 2)


def clean_daily_base(dcl: DataFrame) -> DataFrame:
    """Daily attributes as the base-table script selects them (extra kg kept raw)."""
    return dcl.select(
        "day_id", "store_id", "date", "day_of_week",
        holiday_flag(F.col("is_holiday"), F.col("is_pre_holiday")).alias("holiday_status"),
        "first_fried_kg", "second_fried_kg",
        total_fired(dcl).alias("total_fired_kg"),
        "plus_kg", "end_g",
    )


def clean_daily_features(dcl: DataFrame) -> DataFrame:
    """Daily attributes as the feature script selects them (extra kg coalesced to 0)."""
    return dcl.select(
        "day_id", "store_id", "date", "day_of_week", "end_g",
        holiday_flag(F.col("is_holiday"), F.col("is_pre_holiday")).alias("before_rest"),
        "first_fried_kg", "second_fried_kg",
        total_fired(dcl).alias("total_fired_kg"),
        F.coalesce(F.col("plus_kg"), F.lit(0.0)).alias("plus_kg"),
    )


def act_g(sum_g: Column, plus_kg: Column) -> Column:
    """Net demand: total grams minus extra-cooked kg (NULL when plus_kg is NULL)."""
    return sum_g - plus_kg * 1000


def base_daily(odl: DataFrame, dcl: DataFrame) -> DataFrame:
    """Daily analysis base: attributes, 14 bins, totals and ``act_g``."""
    jt = pivot_bins(odl)
    dt = clean_daily_base(dcl).drop("store_id")
    j = jt.join(dt, "day_id", "inner")
    return j.select(
        "day_id", "store_id", "date", "day_of_week", "holiday_status",
        "first_fried_kg", "second_fried_kg", "total_fired_kg", "plus_kg", "end_g",
        *[c(b) for b in BINS30],
        "sum_g", "cnt",
        act_g(F.col("sum_g"), F.col("plus_kg")).alias("act_g"),
    )


def time_table(odl: DataFrame, dcl: DataFrame) -> DataFrame:
    """The ``time_table`` view: bins per day with ``before_rest`` and coalesced extra kg."""
    jt = pivot_bins(odl)
    dt = clean_daily_features(dcl).drop("store_id")
    j = jt.join(dt, "day_id", "inner")
    return j.select(
        "day_id", "store_id", "date", "day_of_week", "before_rest", "end_g",
        *[c(b) for b in BINS30],
        "sum_g", "cnt",
        act_g(F.col("sum_g"), F.col("plus_kg")).alias("act_g"),
    )
