"""Incremental half-hour bin table from an order-line stream.

Order data keeps arriving, and the daily analyses are rerun on it. Each
micro-batch reduces its own lines to (store, half-hour) sums and writes them
into its own ``epoch=<id>`` folder with overwrite, so a retried batch replaces
its own output (idempotent). The table is the sum over epochs: lines count
whenever they arrive, in any file order, and no state is kept between batches.
``compact`` folds many epochs into one folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prepcast.functions.columns import units, from_units
from prepcast.session import scratch_path

EVENTS_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def order_line_stream(spark: SparkSession, folder: str, file_glob: str = "*.parquet",
                      max_files_per_trigger: int = 100) -> DataFrame:
    """Event files landing in ``folder`` as a stream of order lines (same rules as the batch fixture)."""
    ev = (spark.readStream.schema(EVENTS_SCHEMA).option("maxFilesPerTrigger", max_files_per_trigger)
          .option("pathGlobFilter", file_glob).parquet(folder))
    return ev.select(
        F.col("event_type").alias("store_id"),
        F.col("event_id").alias("order_id"),
        F.col("ts").alias("order_datetime"),  # wall-clock time, no zone
        F.col("value").alias("amount_g"),
    )


def half_hour_sums(lines: DataFrame) -> DataFrame:
    """Per store and 30-minute window: exact grams and line count of one batch."""
    return (
        lines.groupBy("store_id", F.window("order_datetime", "30 minutes"))
        .agg(F.sum(units(F.col("amount_g"))).alias("g"), F.count(F.lit(1)).alias("n_lines"))
        .select("store_id", F.col("window.start").cast("timestamp_ntz").alias("bin_start"), "g", "n_lines")
    )


def _append(sink: str):
    def write(batch: DataFrame, epoch_id: int) -> None:
        half_hour_sums(batch).write.mode("overwrite").parquet(f"{sink}/epoch={epoch_id}")
    return write


def _sums(spark: SparkSession, sink: str) -> DataFrame:
    return spark.read.parquet(sink).groupBy("store_id", "bin_start").agg(F.sum("g").alias("g"), F.sum("n_lines").alias("n_lines"))


def read_bins(spark: SparkSession, sink: str) -> DataFrame:
    """Current table: every (store, bin) over all batches so far."""
    return _sums(spark, sink).select("store_id", "bin_start", from_units(F.col("g")).alias("amount_g"), "n_lines")


def compact(spark: SparkSession, sink: str, into: str) -> None:
    """Write the sums of all epochs of ``sink`` as the single epoch -1 of a new sink; the stream goes on there."""
    _sums(spark, sink).write.mode("overwrite").parquet(f"{into}/epoch=-1")


def run_available(spark: SparkSession, folder: str, file_glob: str = "*.parquet", sink: str | None = None,
                  checkpoint: str | None = None) -> DataFrame:
    """Process everything available now (Trigger.AvailableNow) and return the bin table."""
    sink = sink or scratch_path(spark, "bins_stream_sink")
    checkpoint = checkpoint or scratch_path(spark, "bins_stream_ckpt")
    q = (
        order_line_stream(spark, folder, file_glob)
        .writeStream.foreachBatch(_append(sink))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    q.awaitTermination()
    return read_bins(spark, sink)
