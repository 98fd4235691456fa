"""Benchmark decontamination by spaced-seed hashing.

A seed is a fixed mask over consecutive words; words under its gaps are ignored,
so a hit survives substitutions there. Words are runs of ASCII letters, digits
and non-ASCII bytes, A-Z as a-z. The hashes of all masks over the benchmark items
and over the documents are joined; a Bloom filter of fixed size made from the
benchmark's hashes keeps back document hashes that can't join. Every hit gives a
diagonal (document position - item position); around it the words are compared
one by one, without gaps, and the longest segment in which at least 80 % agree must
hold enough matching words.

An item of n words is found in a document when a segment has
min(``NEED``, max(5, 0.8 n)) matching words or more. Items shorter than a mask are
matched by their whole word sequence; items under five words are too short to
tell and never match. Items under ``SHORT`` words get three more masks, with which
some mask fits every way to reach the needed matches (a test tries them all).

Defined cases: null texts are empty and never match; repeated benchmark rows with
one item_id count once, those without an item_id are items each and reported
together under a null item_id; repeated documents count each; an empty table on
either side gives no matches; other columns are ignored by ``overlaps`` and kept by
``clean``, which judges every row by its own text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.scratch import TEXT_ROWS, small_batches, written
from prepcast.llm.text import mix, slices, text_buffer, word_bounds, word_hashes

MASKS = ("111111", "1110111", "11011011", "111101111", "1101011011")
SHORT_MASKS = ("1111", "111011", "110111")
SHORT = 14
SHORTEST = 5
NEED = 12
REACH = 48
BLOOM_BITS = 25
_U = np.uint64
SEPARATOR = np.ones(256, bool)
SEPARATOR[48:58] = SEPARATOR[65:91] = SEPARATOR[97:123] = SEPARATOR[128:] = False
_FACTOR = np.random.default_rng(5).integers(0, 2**63, 64, dtype=np.uint64) * _U(2) + _U(1)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_buffer(column)
    starts, ends, first = word_bounds(data, offs, SEPARATOR)
    return word_hashes(data, starts, ends), first


def masks_of(n: int) -> list[str]:
    """The masks for an item of ``n`` words; one too long for it is its whole sequence."""
    return sorted({m if len(m) <= n else "1" * n for m in (MASKS + SHORT_MASKS if n < SHORT else MASKS)})


def seeds(words: np.ndarray, first: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(keys, start word) of a mask over each text; the key depends on the mask."""
    n, span = len(words), len(mask)
    if n < span:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    total = np.full(n - span + 1, int(mask, 2) * 2 + 1, _U)
    for j, bit in enumerate(mask):
        if bit == "1":
            total += words[j:n - span + 1 + j] * _FACTOR[j]
    whole = np.ones(n - span + 1, bool)
    for border in first[1:-1]:
        whole[max(0, border - span + 1):border] = False
    at = np.flatnonzero(whole)
    return mix(total[at]), at


def _probes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return keys >> _U(64 - BLOOM_BITS), keys & _U((1 << BLOOM_BITS) - 1)


def _items(benchmark: DataFrame) -> DataFrame:
    """(item, item_id, words) of the items long enough to match; ``item`` is a number of its own for each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at = TaskContext.get().partitionId() << 40
        for batch in slices(batches, "text", 4 << 20):
            words, first = words_of(batch.column("text"))
            long = np.flatnonzero(np.diff(first) >= SHORTEST)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(long))), batch.column("item_id").take(pa.array(long)), pa.array([words[first[i]:first[i + 1]].view(np.int64) for i in long], pa.list_(pa.int64()))], names=["item", "item_id", "words"])
            at += len(long)

    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropDuplicates().mapInArrow(run, "item long, item_id long, words array<long>")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(key, item, at): every mask over every item, or the whole of an item shorter than a mask."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, words in zip(batch.column("item").to_pylist(), batch.column("words").to_pylist()):
                arr = np.array(words, np.int64).view(_U)
                for mask in masks_of(len(arr)):
                    keys, at = seeds(arr, np.array([0, len(arr)]), mask)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array([item] * len(at), pa.int64()), pa.array(at, pa.int64())], names=["key", "item", "at"])

    return items.mapInArrow(run, "key long, item long, at long").distinct()


def _bloom(item_seeds: DataFrame) -> np.ndarray:
    """Bit table of both probes of every benchmark key; at most 2**BLOOM_BITS / 32 rows reach the driver."""
    key, bits = F.col("key"), 1 << BLOOM_BITS
    probe = F.explode(F.array(F.shiftrightunsigned(key, 64 - BLOOM_BITS), key.bitwiseAND(F.lit(bits - 1).cast("long")))).alias("bit")
    rows = item_seeds.select(probe).groupBy(F.shiftright("bit", 5).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 31 as int))")).alias("set")).toArrow()
    table = np.zeros(bits // 32, np.uint32)
    table[rows.column("word").to_numpy()] = rows.column("set").to_numpy().astype(np.uint32)
    return table


def _hits(docs: DataFrame, bloom, masks: list[str]) -> DataFrame:
    """One row per document with hits: seed keys and places, and the word hashes around them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        uid, table = TaskContext.get().partitionId() << 40, bloom.value
        for batch in slices(batches, "text", 4 << 20):
            words, first = words_of(batch.column("text"))
            got_keys, got_at = [], []
            for mask in masks:
                keys, at = seeds(words, first, mask)
                one, two = _probes(keys)
                there = ((table[one >> _U(5)] >> (one & _U(31)).astype(np.uint32)) & (table[two >> _U(5)] >> (two & _U(31)).astype(np.uint32)) & 1).astype(bool)
                got_keys.append(keys[there])
                got_at.append(at[there])
            keys, at = np.concatenate(got_keys), np.concatenate(got_at)
            text = np.searchsorted(first, at, "right") - 1
            order = np.lexsort((at, text))
            keys, at, text = keys[order], at[order], text[order]
            owner, begin = np.unique(text, return_index=True)
            rows: list[list] = [[] for _ in range(7)]
            for i, a, b in zip(owner.tolist(), begin.tolist(), [*begin[1:].tolist(), len(text)]):
                lo, hi = first[i], first[i + 1]
                spot = np.unique(at[a:b])
                step = np.zeros(hi - lo + 1, np.int64)
                np.add.at(step, np.maximum(spot - REACH, lo) - lo, 1)
                np.add.at(step, np.minimum(spot + REACH, hi) - lo, -1)
                near = np.flatnonzero(np.cumsum(step)[:-1])
                for column, value in zip(rows, (uid, batch.column("doc_id")[i].as_py(), batch.column("th")[i].as_py(), keys[a:b].view(np.int64), at[a:b] - lo, near, words[lo:hi][near].view(np.int64))):
                    column.append(value)
                uid += 1
            kinds = (*[pa.int64()] * 3, *[pa.list_(pa.int64())] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["uid", "doc_id", "th", "keys", "at", "near", "words"])

    return docs.mapInArrow(run, "uid long, doc_id long, th long, keys array<long>, at array<long>, near array<long>, words array<long>")


def best_segment(same: np.ndarray) -> tuple[int, int, int]:
    """(begin, end, matches) of the longest stretch in which at least four of five words agree, cut to its matches."""
    run = np.concatenate([[0], np.cumsum(np.where(same, 1, -4))])
    ahead = np.maximum.accumulate(run[::-1])[::-1]  # best sum from each place on: falls along the item
    begin = np.arange(len(run))
    end = len(run) - np.searchsorted(ahead[::-1], run, "left") - 1  # last place whose sum is no less
    best = int((end - begin).argmax())
    hits = np.flatnonzero(same[best:int(end[best])])
    if not len(hits):
        return 0, 0, 0
    return best + int(hits[0]), best + int(hits[-1]) + 1, len(hits)


_FOUND = ("doc_id", "th", "uid", "item_id", "start_word", "end_word", "matched_words", "item_words")


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc, th, uid, item, diagonal, near, words, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "th", "uid", "item_id", "diagonal", "near", "words", "item_words"))):
            place = np.array(near) - diagonal
            inside = (place >= 0) & (place < len(wanted))
            same = np.zeros(len(wanted), bool)
            same[place[inside]] = np.array(words, np.int64)[inside] == np.array(wanted, np.int64)[place[inside]]
            begin, end, matches = best_segment(same)
            if matches >= min(NEED, max(SHORTEST, -(-4 * len(wanted) // 5))):
                rows.append((doc, th, uid, item, begin + diagonal, end + diagonal, matches, len(wanted)))
        cols = list(zip(*rows)) or [()] * len(_FOUND)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=list(_FOUND))


def _overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``overlaps`` with ``th``, the hash of the row's text."""
    spark = docs.sparkSession
    items = written(_items(benchmark), "decontaminate-items")
    item_seeds = written(_item_seeds(items), "decontaminate-seeds")
    lengths = [r["n"] for r in items.select(F.size("words").alias("n")).where(f"n < {SHORT}").distinct().collect()]  # at most nine values
    masks = sorted({*MASKS, *(m for n in lengths for m in masks_of(n))})
    bloom = spark.sparkContext.broadcast(_bloom(item_seeds))
    with small_batches(spark, TEXT_ROWS):
        hits = written(_hits(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text"), bloom, masks), "decontaminate-hits")
    each = hits.select("uid", F.explode(F.arrays_zip("keys", "at")).alias("h")).select("uid", F.col("h.keys").alias("key"), F.col("h.at").alias("doc_at"))
    diagonals = each.join(item_seeds, "key").select("uid", "item", (F.col("doc_at") - F.col("at")).alias("diagonal")).distinct()
    placed = diagonals.join(items.withColumnRenamed("words", "item_words"), "item").join(hits.select("uid", "doc_id", "th", "near", "words"), "uid")
    found = placed.mapInArrow(_verify, ", ".join(f"{c} long" for c in _FOUND))
    best = F.max(F.struct("matched_words", F.expr("-start_word as before"), "end_word", "item_words")).alias("best")
    per_row = found.groupBy("uid", "doc_id", "th", "item_id").agg(best)
    return per_row.select("doc_id", "th", "item_id", F.expr("-best.before").alias("start_word"), "best.end_word", "best.matched_words", "best.item_words")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document row and item found: doc_id, item_id, start_word, end_word, matched_words, item_words."""
    return _overlaps(docs, benchmark).drop("th")


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose own text overlaps no item, all columns as they are."""
    bad = written(_overlaps(docs, benchmark).select(F.col("doc_id").alias("__bad"), F.col("th").alias("__th")).distinct(), "decontaminate-found")
    return docs.join(bad, docs["doc_id"].cast("long").eqNullSafe(bad["__bad"]) & (F.xxhash64(docs["text"]) == bad["__th"]), "left_anti")
