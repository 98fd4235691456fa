"""Strategy back-test: gut-feel amount (A) vs model (B) vs constant mean (C).

All plain column expressions and small grouped averages over the validation
rows joined to their group's predictions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.functions.columns import div, rnd, rnd_even

# Fixed values of the reference's strategy A: 10 kg prepared at an 88 % yield.
PREP_KG, YIELD = 10.0, 0.88
DIGITS = 4


def residuals(valid: DataFrame, target: str, prediction: str, c_value: str, groups: list[str]) -> DataFrame:
    """A = prep*yield*1000 - y, B = round_half_even(prediction - y), C = c_value - y."""
    y = F.col(target)
    return valid.withColumns({
        "A_residual": F.lit(PREP_KG * YIELD * 1000) - y,
        "B_residual": rnd_even(F.col(prediction) - y, 0),
        "C_residual": F.col(c_value) - y,
    })


def wins(res: DataFrame) -> DataFrame:
    out = res.withColumns({
        "A_abs": F.abs("A_residual"), "B_abs": F.abs("B_residual"), "C_abs": F.abs("C_residual"),
    })
    return out.withColumns({
        "B_beats_A": F.col("B_abs") < F.col("A_abs"),
        "B_beats_C": F.col("B_abs") < F.col("C_abs"),
    }).withColumn("B_wins_both", F.col("B_beats_A") & F.col("B_beats_C"))


def rates(w: DataFrame, groups: list[str]) -> DataFrame:
    """Win shares and MAE per strategy."""
    return w.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg(F.col("B_beats_A").cast("int")), DIGITS).alias("rate_B_beats_A"),
        rnd(F.avg(F.col("B_beats_C").cast("int")), DIGITS).alias("rate_B_beats_C"),
        rnd(F.avg(F.col("B_wins_both").cast("int")), DIGITS).alias("rate_B_wins_both"),
        rnd(F.avg("A_abs"), DIGITS).alias("mae_A"), rnd(F.avg("B_abs"), DIGITS).alias("mae_B"),
        rnd(F.avg("C_abs"), DIGITS).alias("mae_C"),
    )


def split_mae(w: DataFrame, groups: list[str]) -> DataFrame:
    """MAE per strategy for the days B won both comparisons and for the rest."""
    return w.groupBy(*groups, "B_wins_both").agg(
        F.count(F.lit(1)).alias("n"),
        rnd(F.avg("A_abs"), DIGITS).alias("mae_A"), rnd(F.avg("B_abs"), DIGITS).alias("mae_B"),
        rnd(F.avg("C_abs"), DIGITS).alias("mae_C"),
    )


def change_rate(w: DataFrame, groups: list[str]) -> DataFrame:
    """(A - B) / A * 100 on wins; |(A - B) / A * 100| on losses."""
    s = w.groupBy(*groups).agg(
        F.avg(F.when(F.col("B_wins_both"), F.col("A_abs"))).alias("_ah"),
        F.avg(F.when(F.col("B_wins_both"), F.col("B_abs"))).alias("_bh"),
        F.avg(F.when(~F.col("B_wins_both"), F.col("A_abs"))).alias("_am"),
        F.avg(F.when(~F.col("B_wins_both"), F.col("B_abs"))).alias("_bm"),
    )
    return s.select(*groups,
                    rnd(div(F.col("_ah") - F.col("_bh"), F.col("_ah")) * 100, DIGITS).alias("success_rate"),
                    rnd(F.abs(div(F.col("_am") - F.col("_bm"), F.col("_am")) * 100), DIGITS).alias("failure_rate"))


def gap(valid: DataFrame, feature: str, target: str) -> DataFrame:
    return valid.withColumn("gap", F.col(feature) - F.col(target))
