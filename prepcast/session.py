"""Session helpers: a local session for tests/bench, and a shared scratch folder.

Library code never creates a session of its own; it takes the caller's.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "prepcast") -> SparkSession:
    """Session used by tests and bench.py (local mode, UI off, AQE on, UTC)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PREPCAST_DRIVER_MEMORY", "16g"))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The folder named by ``spark.checkpoint.dir`` is used as is. Only a local
    session may leave it unset (a fresh folder under /tmp is taken): on a
    cluster every executor would write to its own disk.
    """
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        require_local(spark.sparkContext.master)
        conf = tempfile.mkdtemp(prefix="prepcast-ckpt-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(conf)
    return spark.sparkContext.getCheckpointDir() or conf


def require_local(master: str) -> None:
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def written_table(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet into the shared checkpoint folder
    and reading it back.

    The write runs once through adaptive execution (so a small result lands in
    few files and a large one is spread by ``keys``, a key too large for one task over
    several); the returned frame is a plain scan, sized by file splits, that survives executor loss.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    out = df.hint("rebalance", *[F.col(k) for k in keys]) if keys else df
    out.write.mode("overwrite").parquet(path)
    return spark.read.schema(out.schema).parquet(path)
