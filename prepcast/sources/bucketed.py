"""The two logs stored in buckets of the day, so that daily jobs need no shuffle.

``bucketed`` deals a table to a fixed number of buckets by its keys and registers it in
the session's catalog. Two tables with equal keys and bucket counts are read bucket by bucket:
grouping order lines by day, joining them to the daily log and checking their days
against it then run without an exchange on either side, however often they repeat.

A bucket is read by one task. Bucket where no single day holds a large share of all rows (a
day's lines of one store do not); a log with such a day stays unbucketed, where the map-side
part of the aggregation takes the load. Rows without a day share one bucket.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from prepcast.session import scratch_path

KEYS = ["day_id"]


def bucketed(df: DataFrame, name: str, buckets: int, keys: list[str] = KEYS, path: str | None = None) -> DataFrame:
    """Write ``df`` to ``path`` (a fresh one in the shared folder unless given) in ``buckets`` files sorted by ``keys``, and read it as a table.

    The rows are dealt before the write by the hash that names the buckets, so each task writes one file.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, name)
    table = path.rstrip("/").rsplit("/", 1)[-1].replace("-", "_")
    dealt = df.repartition(buckets, *keys).sortWithinPartitions(*keys)
    dealt.write.format("parquet").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def bucketed_logs(odl: DataFrame, dcl: DataFrame, buckets: int) -> tuple[DataFrame, DataFrame]:
    """Both logs in the same buckets of ``day_id``; choose ``buckets`` so that one is a few hundred megabytes of order lines."""
    return bucketed(odl, "order-lines", buckets), bucketed(dcl, "daily-log", buckets)
