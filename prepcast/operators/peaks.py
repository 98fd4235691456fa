"""Peak-time detection: bins whose share of the day exceeds mean + 1 SD.

Plan: one aggregation per (day, bin) (partial + final hash aggregate), then
per-day windows for the share, running share and the day's mean / population
SD. The reference re-joins the rows to a grouped copy of themselves; here the
statistics are window aggregates, so there is no join. The only shuffle of
order-line volume is the map-side-combined (day, bin) aggregate; the window's
exchange on ``day_id`` moves at most 48 rows per day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepcast.functions.columns import bin30, bin30_index, bin30_label, bin60_label, units, div, from_units, holiday_flag, rnd
from prepcast.operators.daily import day_totals


def bin_sums(odl: DataFrame, label: str = "hh_mm", width: int = 30) -> DataFrame:
    """SUM(amount_g) per (day, bin), exact.

    Grouped on an integer slot (half-hour index or hour); the 'HH:MM' label is
    formatted once per aggregated row, not per order line. Zero-padded labels
    sort like the slots, so window orderings are unchanged.
    """
    ts = F.col("order_datetime")
    slot = bin30_index(ts) if width == 30 else F.hour(ts)
    agg = (
        odl.select("day_id", slot.alias("_slot"), units(F.col("amount_g")).alias("_c"))
        .groupBy("day_id", "_slot")
        .agg(F.sum("_c").alias("cum_units"))
    )
    lab = bin30_label(F.col("_slot")) if width == 30 else bin60_label(F.col("_slot"))
    return agg.select("day_id", lab.alias(label), "cum_units")


def peak30(odl: DataFrame) -> DataFrame:
    """Half-hour peaks: share > ROUND(avg + 1 SD, 2); also reports the 2 SD level."""
    s = bin_sums(odl, "hh_mm", 30)
    day = Window.partitionBy("day_id")
    total = from_units(F.sum("cum_units").over(day))
    share = s.withColumns({
        "pct": rnd(div(from_units(F.col("cum_units")), total) * 100, 2),
        "cum_pct": rnd(div(from_units(F.sum("cum_units").over(day.orderBy("hh_mm"))), total) * 100, 2),
    })
    stats = share.withColumns({
        "daily_peak_pct": rnd(F.avg("pct").over(day) + F.stddev_pop("pct").over(day), 2),
        "daily_2peek_pct": rnd(F.avg("pct").over(day) + 2 * F.stddev_pop("pct").over(day), 2),
    })
    return (
        stats.filter(F.col("pct") > F.col("daily_peak_pct"))
        .select("day_id", "hh_mm", "pct", "daily_peak_pct", "daily_2peek_pct")
        .orderBy("day_id", "hh_mm")
    )


def peak60(odl: DataFrame, digits: int = 8) -> DataFrame:
    """Hourly peaks: share > avg + 1 SD, threshold not rounded before the test.

    The emitted thresholds are rounded to ``digits`` decimals so that engines
    with different summation orders print the same value.
    """
    s = bin_sums(odl, "bin_hour", 60).withColumn("sum_kg", from_units(F.col("cum_units")) / F.lit(1000.0))
    day = Window.partitionBy("day_id")
    total = from_units(F.sum("cum_units").over(day)) / F.lit(1000.0)
    share = s.withColumns({
        "pct": rnd(div(F.col("sum_kg"), total) * 100, 2),
        "cum_pct": rnd(div(from_units(F.sum("cum_units").over(day.orderBy("bin_hour"))) / F.lit(1000.0), total) * 100, 2),
    })
    stats = share.withColumns({
        "peek_time_raw": F.avg("pct").over(day) + F.stddev_pop("pct").over(day),
        "peek_time_2_raw": F.avg("pct").over(day) + 2 * F.stddev_pop("pct").over(day),
    })
    return (
        stats.filter(F.col("pct") > F.col("peek_time_raw"))
        .select(
            "day_id", "bin_hour", "pct",
            rnd(F.col("peek_time_raw"), digits).alias("peek_time"),
            rnd(F.col("peek_time_2_raw"), digits).alias("peek_time_2"),
        )
        .orderBy("day_id", "bin_hour")
    )


def share_table(odl: DataFrame) -> DataFrame:
    """Per (day, half-hour): bin sum, day total, share and running share."""
    s = bin_sums(odl, "hh_mm", 30)
    day = Window.partitionBy("day_id")
    total = from_units(F.sum("cum_units").over(day))
    return s.select(
        "day_id", "hh_mm",
        from_units(F.col("cum_units")).alias("cum_bin"),
        total.alias("total"),
        rnd(div(from_units(F.col("cum_units")), total) * 100, 2).alias("pct"),
        rnd(div(from_units(F.sum("cum_units").over(day.orderBy("hh_mm"))), total) * 100, 2).alias("cum_pct"),
    )


def holiday_totals(odl: DataFrame, dcl: DataFrame) -> DataFrame:
    """Day flags + the day's total in kg (child aggregated, then joined)."""
    t = day_totals(odl, ["day_id"]).select("day_id", rnd(F.col("sum_g") / 1000, 2).alias("sum_kg"))
    return dcl.join(t, "day_id", "inner").select(
        "day_id", "day_of_week", "is_holiday", "is_pre_holiday",
        holiday_flag(F.col("is_holiday"), F.col("is_pre_holiday")).alias("holiday_or_eve"),
        "sum_kg",
    )


def with_day_total(odl: DataFrame, name: str = "day_total_g") -> DataFrame:
    """Each order row with its day's total grams.

    Written as a partial + final aggregate joined back on ``day_id`` rather
    than a window over order lines: a window would put every line of a hot day
    into one task, while the aggregate combines map-side and the join's small
    side (one row per day) is broadcast or, if large, skew-split by AQE.
    """
    totals = odl.groupBy("day_id").agg(from_units(F.sum(units(F.col("amount_g")))).alias(name))
    return odl.join(totals, "day_id", "inner")


def row_bins(odl: DataFrame) -> DataFrame:
    """Order rows with their half-hour label and the day's total."""
    return with_day_total(odl).select(
        "day_id", "amount_g", "order_datetime", bin30(F.col("order_datetime")).alias("hh_mm"), "day_total_g",
    )
