"""Publishing tables so that readers never see half of a change.

``replace_dates`` rewrites only the dates that a result holds (dynamic partition
overwrite). ``publish`` writes several tables of one version, parent and child, and makes
them visible together by one appended commit row: a write that fails before
leaves the former version in place.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def replace_dates(df: DataFrame, path: str, by: str = "date") -> None:
    """Overwrite the partitions of ``path`` that ``df`` has rows of; the others stay as they are."""
    df.repartition(by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def versions(spark: SparkSession, path: str) -> list[str]:
    """Committed versions, oldest first."""
    try:
        rows = spark.read.schema("n long, version string").parquet(f"{path}/commits").orderBy("n").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return []
    return [r["version"] for r in rows]


def publish(tables: dict[str, DataFrame], path: str) -> str:
    """Write all tables of a new version, then commit it. Returns the version."""
    spark = next(iter(tables.values())).sparkSession
    n, version = len(versions(spark, path)), uuid.uuid4().hex
    for name, df in tables.items():
        df.write.parquet(f"{path}/{version}/{name}")
    spark.range(1).select(F.lit(n).cast("long").alias("n"), F.lit(version).alias("version")).coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return version


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the last committed version."""
    return spark.read.parquet(f"{path}/{versions(spark, path)[-1]}/{name}")
