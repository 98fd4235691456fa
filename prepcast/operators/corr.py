"""Pairwise-complete Pearson correlations as one aggregate.

``corr`` raises on a constant column, so r is built from regr_sxy / regr_sxx /
regr_syy, which use exactly the rows where both values are present; a zero
variance gives NULL. All pairs of a matrix are computed in one pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepcast.operators.moments import pair_moments

DIGITS = 6


def pearson(y: str, x: str) -> Column:
    sxy = F.expr(f"regr_sxy(`{y}`, `{x}`)")
    den = F.sqrt(F.expr(f"regr_sxx(`{y}`, `{x}`)") * F.expr(f"regr_syy(`{y}`, `{x}`)"))
    return F.round(F.try_divide(sxy, F.when(den != 0, den)), DIGITS)


def corr_matrix(df: DataFrame, cols: list[str], groups: list[str]) -> DataFrame:
    """Long matrix: (groups, x, y, r, n) for every ordered pair of ``cols``, from one pass of matrix products (``moments``)."""
    m = pair_moments(df, cols, groups)
    den = F.sqrt(F.col("sxx") * F.col("syy"))
    upper = m.select(*groups, "x", "y", F.round(F.try_divide(F.col("sxy"), F.when(den != 0, den)), DIGITS).alias("r"), "n")
    # both orientations from the same aggregated row (no second branch, no union)
    both = F.when(F.col("x") == F.col("y"), F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")))).otherwise(
        F.array(F.struct(F.col("x").alias("x"), F.col("y").alias("y")), F.struct(F.col("y").alias("x"), F.col("x").alias("y"))))
    return upper.select(*groups, F.explode(both).alias("_o"), "r", "n").select(*groups, "_o.x", "_o.y", "r", "n")


def corr_target(df: DataFrame, cols: list[str], target: str, groups: list[str]) -> DataFrame:
    """Correlation of every column with ``target`` (target row included, as in pandas)."""
    agg = df.groupBy(*groups).agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), pearson(target, c).alias("r"))
        for i, c in enumerate(cols)
    ]).alias("_p"))
    return agg.select(*groups, F.explode("_p").alias("_p")).select(*groups, "_p.*")


def corr_with_without(df: DataFrame, cols: list[str], target: str, groups: list[str], exclude_dates: list[str]) -> DataFrame:
    """Side by side: r with all rows and r without the listed dates (one pass, masked columns)."""
    keep = ~F.col("date").isin(*[F.lit(d).cast("date") for d in exclude_dates]) | F.col("date").isNull()
    masked = df.select(*groups, *[F.col(c) for c in dict.fromkeys([target, *cols])],
                       *[F.when(keep, F.col(c)).alias(f"__x_{c}") for c in dict.fromkeys([target, *cols])])
    agg = masked.groupBy(*groups).agg(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("pos"), pearson(target, c).alias("r_incl"),
                 pearson(f"__x_{target}", f"__x_{c}").alias("r_excl"))
        for i, c in enumerate(cols)
    ]).alias("_p"))
    return agg.select(*groups, F.explode("_p").alias("_p")).select(*groups, "_p.*")


def select_candidates(df: DataFrame, cols: list[str], target: str, groups: list[str], threshold: float = 0.3) -> DataFrame:
    """Features with |r| > threshold (strict), target excluded, list order kept in ``pos``."""
    ct = corr_target(df, cols, target, groups)
    return ct.filter((F.abs("r") > threshold) & (F.col("feature") != target))


def sorted_desc(ct: DataFrame, groups: list[str]) -> DataFrame:
    """Descending by r with NULLs last, within each group."""
    return ct.orderBy(*groups, F.col("r").desc_nulls_last())
