"""Utilisation KPI with estimated carry-over stock.

The reference groups the *joined* rows by the parent key; Spark would keep
that aggregate above the join, so here the child is aggregated first (one
row per day) and joined after: same result, the join input shrinks from
order lines to days.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.functions.columns import div, rnd
from prepcast.operators.daily import day_totals

# Fixed labels of the two estimation cases.
ESTIMABLE, NOT_ESTIMABLE = "추정 가능", "추정 불가"


def daily_kg(odl: DataFrame) -> DataFrame:
    """Daily consumption in kg: ROUND(SUM(g)/1000, 2)."""
    return day_totals(odl, ["day_id"]).select("day_id", rnd(F.col("sum_g") / 1000, 2).alias("amount_kg"))


def _fried_sum():
    return F.col("first_fried_kg") + F.col("second_fried_kg")


def carry_inputs(odl: DataFrame, dcl: DataFrame) -> DataFrame:
    """Exploratory case inputs; LEFT JOIN keeps days without orders (NULL sums)."""
    t = day_totals(odl, ["day_id"]).select("day_id", "sum_g")
    j = dcl.join(t, "day_id", "left")
    g_kg = F.col("sum_g") / 1000
    return j.select(
        "day_id", "first_fried_kg", "second_fried_kg",
        rnd(_fried_sum(), 2).alias("total_fried"),
        "plus_kg",
        rnd(F.col("end_g") / 1000, 2).alias("end_amount"),
        rnd(g_kg - F.coalesce(F.col("plus_kg"), F.lit(0.0)), 2).alias("ft_amount"),
        rnd(g_kg, 2).alias("amount_kg"),
        rnd(_fried_sum() - ((F.col("end_g") + F.col("sum_g")) / 1000 - F.col("plus_kg")), 1).alias("rka"),
        rnd((_fried_sum() - F.col("end_g") / 1000) - g_kg, 1).alias("ex_fried_kg"),
    )


def utilisation(odl: DataFrame, dcl: DataFrame) -> DataFrame:
    """using_rate = amount / (today's fried stock + estimated carry-over)."""
    t = day_totals(odl, ["day_id"]).select("day_id", "sum_g")
    j = dcl.join(t, "day_id", "inner")
    plus = F.coalesce(F.col("plus_kg"), F.lit(0.0))
    ex = j.select(
        "day_id",
        rnd(_fried_sum(), 2).alias("total_fried"),
        rnd(F.col("end_g") / 1000, 2).alias("end_amount"),
        rnd(F.col("sum_g") / 1000 - plus, 2).alias("amount_kg"),
        rnd(_fried_sum() - ((F.col("end_g") + F.col("sum_g")) / 1000 - plus), 1).alias("ex_fried_kg"),
    )
    pre = ex.withColumns({
        "pre_fried_kg": F.when(F.col("ex_fried_kg") < 0, F.abs("ex_fried_kg")),
        "label": F.when(F.col("ex_fried_kg") < 0, F.lit(ESTIMABLE)).otherwise(F.lit(NOT_ESTIMABLE)),
    })
    kpi = pre.withColumn(
        "total_pre_kg",
        F.when(F.col("label") == ESTIMABLE, rnd(F.col("total_fried") + F.col("pre_fried_kg"), 1)).otherwise(F.col("total_fried")),
    )
    return kpi.select(
        "day_id", "total_fried", "end_amount", "amount_kg", "pre_fried_kg", "total_pre_kg",
        rnd(div(F.col("amount_kg"), F.col("total_pre_kg")), 2).alias("using_rate"),
    )
