"""The ``opN_*`` queries: each operator over its whole table with production parameters.

``ORACLE`` holds the DuckDB SQL of those that SQL can express; the others are
tested against brute force in tests/llm.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from prepcast.llm import compression, context_mixing, decontaminate, direct_codes, hard_negatives, html_density, neardup, packing, pii, prefix_trie, quality, substring_dedup, toxicity
from prepcast.llm.scratch import shared_dir
from prepcast.llm.tokens import tokenizer_file

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(spark: SparkSession, name: str) -> str:
    import uuid

    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@register
def op1_direct_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode all documents into a store, read it back, digest every document."""
    path = fresh(spark, "direct-codes")
    direct_codes.write_store(table(spark, sf_dir, "documents"), path, tokenizer_file())
    return direct_codes.digests(direct_codes.read_store(spark, path))


@register
def op3_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents at their sources' own token shares."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file())


@register
def op10_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.assess(table(spark, sf_dir, "documents"))


@register
def op7_additive_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


@register
def op9_ngram_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


@register
def op6_minhash_inverted_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles, similarity 0.8, over all documents."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), k=4, percent=80)


@register
def op2_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per contaminated document and benchmark item."""
    return decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register
def op4_information_sanitising(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@register
def op5_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context_mixing.assess(table(spark, sf_dir, "documents"))


@register
def op8_lyndon_grouped_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.dedup(table(spark, sf_dir, "documents")).drop("kept")


@register
def op11_rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anchors are every 50th vec_id, five positives, three negatives at 50 to 95 percent; every 7th row gets the next label first."""
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.select("vec_id", moved.alias("label"), "embedding"))


ORACLE["op11_rotated_codes"] = """
WITH v AS MATERIALIZED (
  SELECT CAST(vec_id AS BIGINT) AS id,
         CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (
  SELECT a.id AS anchor, b.id AS other, a.label = b.label AS same, CAST(list_dot_product(a.x, b.x) AS BIGINT) AS score
  FROM v a JOIN v b ON a.id <> b.id WHERE a.id % 50 = 0),
p AS (
  SELECT anchor, other, score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, other) <= 5)
SELECT p.anchor AS anchor_id, p.other AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.other ORDER BY n.score DESC, n.other) AS INTEGER) AS rank,
       n.other AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM p JOIN s n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""


@register
def op12_contracted_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


ORACLE["op12_contracted_trie"] = """
WITH t AS MATERIALIZED (
  SELECT CAST(conv_id AS BIGINT) AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, turn,
         sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS MATERIALIZED (
  SELECT c, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, digest) AS place, digest, length(text) AS chars FROM t),
own AS MATERIALIZED (
  SELECT c, max(place) AS n, c - c % 100 AS base,
         xor(list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(c AS VARCHAR)) + 1), lambda i: CAST(ascii(substr(CAST(c AS VARCHAR), i, 1)) AS BIGINT))),
             lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)), 4294967295) % 6 AS h
  FROM placed GROUP BY c),
convs AS MATERIALIZED (
  SELECT o.c, o.n, o.h, o.base, least(o.h, coalesce(b.n, 0)) AS head, least(o.h, coalesce(b.n, 0)) + greatest(o.n - o.h, 0) AS len
  FROM own o LEFT JOIN own b ON b.c = o.base),
turns AS MATERIALIZED (
  SELECT v.c, p.place, p.digest, p.chars FROM convs v JOIN placed p ON p.c = v.base AND p.place <= v.head
  UNION ALL
  SELECT v.c, p.place - v.h + v.head, p.digest, p.chars FROM convs v JOIN placed p ON p.c = v.c AND p.place > v.h),
paths AS MATERIALIZED (
  SELECT c, place AS depth, string_agg(digest, ',') OVER w AS k, chars FROM turns WINDOW w AS (PARTITION BY c ORDER BY place)
  UNION ALL SELECT c, 0, '', 0 FROM convs),
nodes AS MATERIALIZED (
  SELECT k, min(c) AS conv_id, min(depth) AS depth, count(*) AS n_convs, min(chars) AS chars FROM paths GROUP BY k),
kids AS MATERIALIZED (
  SELECT up.k, count(*) AS n_children FROM nodes x JOIN paths up ON up.c = x.conv_id AND up.depth = x.depth - 1 GROUP BY up.k),
weighed AS MATERIALIZED (
  SELECT x.*, coalesce(y.n_children, 0) AS n_children FROM nodes x LEFT JOIN kids y ON y.k = x.k),
totals AS (
  SELECT up.k, sum(CASE WHEN x.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((x.n_convs - 1) * x.chars) AS saved_tokens
  FROM weighed x JOIN paths up ON up.c = x.conv_id AND up.depth <= x.depth GROUP BY up.k),
ends AS (
  SELECT p.k, string_agg(CAST(p.c AS VARCHAR), ',' ORDER BY p.c) AS ids FROM paths p JOIN convs v ON v.c = p.c AND v.len = p.depth GROUP BY p.k),
ups AS (
  SELECT x.k, u.conv_id AS parent_conv_id FROM nodes x JOIN paths up ON up.c = x.conv_id AND up.depth = x.depth - 1 JOIN nodes u ON u.k = up.k)
SELECT CAST(x.conv_id AS BIGINT) AS conv_id, CAST(x.depth AS BIGINT) AS depth, CAST(u.parent_conv_id AS BIGINT) AS parent_conv_id,
       CAST(x.n_convs AS BIGINT) AS n_convs, CAST(x.n_children AS BIGINT) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves,
       CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(e.ids, '')) AS ends_sha256
FROM weighed x JOIN totals s ON s.k = x.k LEFT JOIN ups u ON u.k = x.k LEFT JOIN ends e ON e.k = x.k
"""


@register
def op13_composite_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_density.extract(table(spark, sf_dir, "pages"))


@register
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
