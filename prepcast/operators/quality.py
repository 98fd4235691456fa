"""Key and reference checks that MySQL enforced with PK / UNIQUE / FK.

All are distributed jobs: a grouped count for duplicates and semi / anti
joins for the foreign key. The parent is one row per store-day, so the anti
join's build side is small; Spark's planner (with AQE) decides whether to
broadcast it from its measured size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def key_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by an explicit order (deterministic dedup).

    ``min_by`` over a struct of the row is a regular aggregate with a map-side
    combine, so a key duplicated millions of times never gathers in one task.
    Ties in ``order`` are broken by the row's own values.
    """
    others = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in others])
    best = F.min_by(row, F.struct(*order, row)).alias("_first")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_first.{c}").alias(c) for c in others])


def orphans(child: DataFrame, parent: DataFrame, key: str = "day_id") -> DataFrame:
    """Child rows without a parent (FK violations)."""
    return child.join(parent.select(key), key, "left_anti")


def accepted(child: DataFrame, parent: DataFrame, key: str = "day_id") -> DataFrame:
    """Child rows whose parent exists."""
    return child.join(parent.select(key), key, "left_semi")
