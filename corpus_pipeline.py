"""Corpus pipeline: five operators in a row, each stage on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last
return the columns of ``documents``. ``run`` writes each stage's rows as Parquet in
the session's shared folder and reads them again for the next stage.

1. toxicity: documents that the classifier (fit on the labelled rows) rejects go.
2. near_duplicates: five-word shingles, similarity 0.8; the document with the
   smallest doc_id of each group stays (of a group without any doc_id, one row).
   Documents without words are all kept.
3. decontamination: rows whose text overlaps a benchmark item go.
4. personal_data: spans are masked in ``text``; ``n_chars`` is counted anew.
5. packing: token windows with each source's share; one row per piece.

Nulls, empty texts, repeated rows, empty tables and further columns are handled as
the operators' docstrings say; further columns pass through the first four stages.

``ORACLE_SQL`` is None: classifier, signatures and tokenizer are beyond SQL; the
stages are tested against brute force in tests/llm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prepcast.llm import decontaminate, neardup, packing, pii, toxicity
from prepcast.llm.scratch import written
from prepcast.llm.tokens import tokenizer_file

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity.keep_clean(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return neardup.drop_copies(docs, k=5, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.sanitise(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("packing", pack_windows),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
