"""Descriptive aggregates: describe, quantiles, IQR outliers, box summary, SEM.

All exact (linear interpolation, like pandas / numpy) and grouped, at any group
size (``selection.quantiles``); the per-group fences of the IQR filter are a small
grouped table joined back on the group key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.functions.columns import join_groups, rnd
from prepcast.operators.selection import quantiles

DIGITS = 6


def _r(c):
    return rnd(c, DIGITS)


def describe(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """count, mean, sample std, min, 25 %, 50 %, 75 %, max per group."""
    v = df.filter(F.col(value).isNotNull())
    a = v.groupBy(*groups).agg(
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    )
    a = join_groups(a, quantiles(v, value, groups, [0.25, 0.5, 0.75]), groups)
    return a.select(*groups, "count", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"),
                    F.col("min").cast("double").alias("min"),
                    _r(F.col("_q")[0]).alias("p25"), _r(F.col("_q")[1]).alias("p50"), _r(F.col("_q")[2]).alias("p75"),
                    F.col("max").cast("double").alias("max"))


def with_all_group(df: DataFrame, col: str, all_label: str = "ALL") -> DataFrame:
    """Each row once under its own ``col`` value and once under ``all_label`` (overall + per level, one pass)."""
    return df.withColumn(col, F.explode(F.array(F.col(col).cast("string"), F.lit(all_label))))


def quartiles(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Quartiles, median and the 1.5 IQR fences per group."""
    a = quantiles(df, value, groups, [0.25, 0.5, 0.75])
    return a.select(*groups, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")).withColumns({
        "iqr": F.col("q3") - F.col("q1"),
    }).withColumns({
        "lower": F.col("q1") - 1.5 * F.col("iqr"),
        "upper": F.col("q3") + 1.5 * F.col("iqr"),
    })


def iqr_outliers(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Rows below Q1 - 1.5 IQR or above Q3 + 1.5 IQR of their group."""
    fences = quartiles(df, value, groups)
    j = join_groups(df, fences, groups)
    return j.filter((F.col(value) < F.col("lower")) | (F.col(value) > F.col("upper")))


def box_summary(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """Five numbers and the whisker ends (extreme values inside the 1.5 IQR fences)."""
    fences = quartiles(df, value, groups)
    j = join_groups(df.filter(F.col(value).isNotNull()), fences, groups)
    inside = (F.col(value) >= F.col("lower")) & (F.col(value) <= F.col("upper"))
    a = j.groupBy(*groups, "q1", "median", "q3", "lower", "upper").agg(
        F.min(value).alias("min"), F.max(value).alias("max"),
        F.min(F.when(inside, F.col(value))).alias("whisker_low"), F.max(F.when(inside, F.col(value))).alias("whisker_high"),
        F.sum(F.when(~inside, 1).otherwise(0)).alias("n_outliers"),
    )
    return a.select(*groups, F.col("min").cast("double").alias("min"), _r(F.col("q1")).alias("q1"),
                    _r(F.col("median")).alias("median"), _r(F.col("q3")).alias("q3"),
                    F.col("max").cast("double").alias("max"),
                    F.col("whisker_low").cast("double").alias("whisker_low"),
                    F.col("whisker_high").cast("double").alias("whisker_high"), "n_outliers")


def group_mean(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    return df.groupBy(*groups).agg(_r(F.avg(value)).alias("mean"))


def group_sem(df: DataFrame, value: str, groups: list[str]) -> DataFrame:
    """N, mean, sample std and standard error of the mean per group."""
    a = df.filter(F.col(value).isNotNull()).groupBy(*groups).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"))
    return a.select(*groups, "n", _r(F.col("mean")).alias("mean"), _r(F.col("std")).alias("std"),
                    _r(F.col("std") / F.sqrt("n")).alias("sem"))
