"""Influence diagnostics: LOOCV residuals, Cook's distance and outlier propagation.

All from one Gram aggregate and one row pass (``regression.loocv_residuals``);
the worst rows are picked with ``max_by`` (no sort, first date on ties).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.functions.columns import single_series
from prepcast.operators.regression import loocv_residuals

DIGITS = 4


def _r(c):
    return F.round(c, DIGITS)


@single_series
def diagnose(df: DataFrame, feature: str, target: str, groups: list[str]) -> DataFrame:
    """Per row of the one-feature model: LOOCV residual (actual - held-out prediction),
    leverage and Cook's D, plus the group's n and 4/n threshold."""
    rows = df.select(*groups, "date", feature, target).dropna(subset=[feature, target])
    r = loocv_residuals(rows, {"m": [feature]}, target, groups, keep=["date", feature])
    return r.select(
        *groups, "date", F.col(feature), F.col("_y").alias(target),
        F.col("e_loo").alias("loo_resid"), F.col("h").alias("leverage"), F.col("cooks_d"),
        F.col("n"), (F.lit(4.0) / F.col("n")).alias("threshold"),
    )


def loocv_report(diag: DataFrame, groups: list[str]) -> DataFrame:
    """Per row: LOOCV residual, rounded."""
    return diag.select(*groups, "date", _r(F.col("loo_resid")).alias("loo_resid"))


def rmse_without_worst(diag: DataFrame, groups: list[str]) -> DataFrame:
    """RMSE and RMSE without the largest absolute error (no refit)."""
    e2 = F.col("loo_resid") * F.col("loo_resid")
    a = diag.groupBy(*groups).agg(F.count(F.lit(1)).alias("n"), F.sum(e2).alias("_s"), F.max(e2).alias("_m"))
    return a.select(*groups, "n", _r(F.sqrt(F.col("_s") / F.col("n"))).alias("rmse"),
                    _r(F.sqrt(F.try_divide(F.col("_s") - F.col("_m"), F.col("n") - 1))).alias("rmse_wo_worst"))


def _argmax(diag: DataFrame, metric, groups: list[str], cols: list[str]) -> DataFrame:
    key = F.struct(metric.alias("m"), (-F.unix_date("date")).alias("d"))
    return diag.groupBy(*groups).agg(F.max_by(F.struct(*cols), key).alias("_w")).select(*groups, "_w.*")


def worst_row(diag: DataFrame, feature: str, target: str, groups: list[str]) -> DataFrame:
    """The row with the largest |LOOCV residual| (earliest date on ties)."""
    w = _argmax(diag, F.abs("loo_resid"), groups, ["date", feature, target, "loo_resid"])
    return w.withColumn("loo_resid", _r(F.col("loo_resid")))


def drop_worst(diag: DataFrame, groups: list[str]) -> DataFrame:
    """Every row except the argmax one (exactly one row removed per group)."""
    w = _argmax(diag, F.abs("loo_resid"), groups, ["date"])
    return diag.join(w, [*groups, "date"], "left_anti")


def cooks(diag: DataFrame, groups: list[str]) -> DataFrame:
    return diag.select(*groups, "date", _r(F.col("cooks_d")).alias("cooks_d"), _r(F.col("leverage")).alias("leverage"),
                       _r(F.col("threshold")).alias("threshold"),
                       (F.col("cooks_d") > F.col("threshold")).alias("influential"))


def cooks_flagged(diag: DataFrame, groups: list[str]) -> DataFrame:
    """Rows with Cook's D > 4/n (strict)."""
    return cooks(diag.filter(F.col("cooks_d") > F.col("threshold")), groups)


@single_series
def propagation(diag: DataFrame, feature: str, target: str, groups: list[str], lag_days: int = 7) -> DataFrame:
    """Two-row report per group: the Y outlier (max |LOOCV residual|) and the X outlier
    (max Cook's D); propagated iff X.date = Y.date + lag_days and X.feature = Y.target."""
    cols = ["date", feature, target, "cooks_d"]
    y = _argmax(diag, F.abs("loo_resid"), groups, cols)
    x = _argmax(diag, F.col("cooks_d"), groups, cols)
    j = y.alias("y").join(x.alias("x"), groups)
    prop = (F.col("x.date") == F.date_add(F.col("y.date"), lag_days)) & (F.col(f"x.{feature}") == F.col(f"y.{target}"))
    both = j.select(*groups, prop.alias("propagated"),
                    F.array(
                        F.struct(F.lit("Y outlier (max residual)").alias("kind"), *[F.col(f"y.{c}").alias(c) for c in cols]),
                        F.struct(F.lit("X outlier (max leverage)").alias("kind"), *[F.col(f"x.{c}").alias(c) for c in cols]),
                    ).alias("_r"))
    out = both.select(*groups, "propagated", F.explode("_r").alias("_r")).select(*groups, "propagated", "_r.*")
    return out.withColumn("cooks_d", _r(F.col("cooks_d")))
