"""Training rows for the classifiers: a bounded sample of labelled documents, chosen by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(folds: int) -> Column:
    """crc32 of doc_id as text modulo ``folds``; null for a null doc_id."""
    return F.crc32(F.col("doc_id").cast("string")) % folds


def held_out(folds: int, held: int) -> Column:
    return F.coalesce(fold(folds) == held, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, max_rows: int) -> DataFrame:
    """(doc_id, text, y) of at most ``max_rows`` labelled documents outside the held-out fold.

    The rows with the smallest hashes of doc_id are taken, so the choice depends
    neither on partitions nor on order. Null or contradicting labels don't count.
    Only the bounded id list is broadcast; the documents are scanned in place.
    """
    clear = labels.where(F.col(label).isNotNull() & (fold(folds) != held)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min(label).cast("int").alias("y"), F.max(label).cast("int").alias("top")).where("y = top").drop("top")
    chosen = clear.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(chosen), "doc_id")
