"""Named inputs of the registered queries, built from a scale-factor folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepcast.operators.daily import base_daily, time_table
from prepcast.operators.features import model_feature
from prepcast.sources.fixtures import daily_log, order_lines


_PLANS: dict[tuple, DataFrame] = {}


def _memo(name: str, spark: SparkSession, sf_dir: str, build) -> DataFrame:
    """Reuse the analysed plan of a shared input for one session and folder.

    Only the lazy DataFrame (the logical plan) is kept, never data: every
    query still scans the files, but the fixture and feature plans are built
    and analysed once instead of once per query.
    """
    key = (name, id(spark), sf_dir)
    df = _PLANS.get(key)
    if df is None or df.sparkSession is not spark:
        df = build()
        _PLANS[key] = df
    return df


def odl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("odl", spark, sf_dir, lambda: order_lines(spark, sf_dir))


def dcl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("dcl", spark, sf_dir, lambda: daily_log(spark, sf_dir))


def tt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("tt", spark, sf_dir, lambda: time_table(odl(spark, sf_dir), dcl(spark, sf_dir)))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("base", spark, sf_dir, lambda: base_daily(odl(spark, sf_dir), dcl(spark, sf_dir)))


def mf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _memo("mf", spark, sf_dir, lambda: model_feature(tt(spark, sf_dir)))


def h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily totals with weekday / pre-holiday labels, Thursdays excluded (H1/H2 sample)."""
    from prepcast.operators.daily import day_totals
    from prepcast.operators.features import exclude_weekday

    def build():
        t = day_totals(odl(spark, sf_dir), ["day_id"])
        d = exclude_weekday(dcl(spark, sf_dir))
        return d.join(t, "day_id").select("store_id", "day_id", "date", "day_of_week", "is_pre_holiday", "sum_g")

    return _memo("h1", spark, sf_dir, build)


def h3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paired stage targets per day (H3 sample)."""
    from prepcast.operators.features import stage_targets

    return _memo("h3", spark, sf_dir, lambda: stage_targets(tt(spark, sf_dir)).select(
        "store_id", "day_id", "date", "day_of_week", "cumul_16_19", "cumul_20_22"))


def af(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Analysis frame: model features with weekday dummies."""
    from prepcast.operators.features import with_dummies

    return _memo("af", spark, sf_dir, lambda: with_dummies(mf(spark, sf_dir)))
