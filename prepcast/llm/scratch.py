"""Lineage cuts: tables written into the shared folder the session names."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Unset, a local session takes a fresh one under /tmp; a cluster must name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="prepcast-llm-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def written(df: DataFrame, name: str, free: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later steps survive lost executors.

    ``free`` asks the driver's JVM to collect garbage afterwards. Spark deletes
    the shuffle files of a finished job only when the driver collects the job's
    objects, which a small driver does rarely; until then they fill executors' disks.
    The listeners hold them for a moment after the job's end, so it is asked twice.
    """
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    if free:
        for wait in (0.5, 0.2):
            time.sleep(wait)
            df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows of an Arrow batch of whole texts.
TEXT_ROWS = 1000


@contextmanager
def small_batches(spark: SparkSession, rows: int, megabytes: int = 4) -> Iterator[None]:
    """Jobs run inside send rows to Python in Arrow batches of at most ``rows`` rows (about ``megabytes``, where Spark counts them).

    A batch lies in the executor's direct memory and in its Python worker at once. Spark's
    10,000 rows are as many texts, pairs of texts or blocks of texts for every core.
    """
    held = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": f"{megabytes}m"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> str:
    """Write ``df`` as Parquet in the shared folder; the path. ``scan`` reads one or more of them."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return path


def scan(like: DataFrame, *paths: str) -> DataFrame:
    """The rows of all ``paths``, written with the columns of ``like``, by one scan."""
    return like.sparkSession.read.schema(like.schema).parquet(*paths)


def discard(table: DataFrame) -> None:
    """Delete a table that ``written`` returned; call it when all that reads the table has been written itself."""
    spark = table.sparkSession
    files = table.inputFiles()
    if not files:
        return
    path = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
    if path.getParent().getName() != shared_dir(spark).rsplit("/", 1)[-1]:
        raise ValueError(f"{path} is no table of the shared folder")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """Partitions for explicit range or hash dealing; follows the session's shuffle setting."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
