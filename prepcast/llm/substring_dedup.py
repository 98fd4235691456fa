"""Removal of repeated 100-byte strings through suffix arrays of candidate pieces.

1. Every ``WINDOW``-byte string has an anchor, the smallest hash among its
   ``GRAM``-byte substrings (leftmost of equal ones), so equal strings have equal
   anchors at equal places. Consecutive starts with one anchor form an interval.
2. Intervals whose bytes came before in the same document are removed whole. Of
   the others only those whose anchor hash occurs twice or more go on, and among
   intervals with equal bytes those in a later document are removed whole.
3. What is left may share strings with intervals of other bytes on the same
   anchor. Such intervals are cut by the anchor's offset into slots; the strings of
   a slot share their middle (the core). A piece is a few bytes, the core as one
   symbol, and a few bytes. Pieces of equal cores are put into buckets, the suffix
   array of a bucket's pieces is built by Lyndon grouping (``grouped_suffixes``), and
   neighbours in it that agree over a whole window are equal strings: all but the
   first in the corpus are removed. A core with more than ``HOT`` different pieces
   is finished by grouping its windows instead, so no task holds a hot core.
4. The removed ranges are joined to the documents that have any.

Hashes are 64 bits of a polynomial over random byte values, and cores are compared
by 64-bit hash and slot.

Defined cases: a null text is an empty one; texts under 100 bytes lose nothing;
a null doc_id comes after all others; rows with one doc_id (or none) but different
texts are documents of their own, in the order of their text hashes; rows equal in both
are one document listed twice, and lose the same bytes; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.grouped_suffixes import suffix_array
from prepcast.llm.scratch import discard, written
from prepcast.llm.sieve import sieve
from prepcast.llm.text import BYTE, mix, prefix_hash, slices, span_hash, text_buffer, window_hashes

WINDOW, GRAM, SLOT = 100, 20, 9
SPAN = WINDOW - GRAM + 1
CORE = WINDOW - SLOT + 1
BUCKET_PIECES = 2000
HOT = 4096
MIN_BITS, TABLE_BITS = 16, 28
LAST = 2**63 - 1
SLICE_BYTES, BLOCK = 1 << 20, 1 << 15
_U = np.uint64
_RANGE = "doc long, th long, a long, b long"


def _after(*columns: str) -> str:
    """SQL: the row's ``columns`` come after those of the same names in ``top``."""
    mine, top = (", ".join(f"'{c}', {p}{c}" for c in columns) for p in ("", "top."))
    return f"named_struct({mine}) > named_struct({top})"


def intervals(data: np.ndarray, offs: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, ...]:
    """(text, anchor place, first start, last start, anchor hash) of every interval of equal anchors."""
    if len(data) < WINDOW:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, _U),)
    hashes = window_hashes(prefix, GRAM)
    q = _least_places(hashes)
    room = np.maximum(np.diff(offs) - WINDOW + 1, 0)
    new = np.ones(len(q), bool)
    new[1:] = q[1:] != q[:-1]
    new[offs[:-1][room > 0]] = True
    stop = np.minimum(offs[1:], len(q))
    short = np.maximum(stop - offs[:-1] - room, 0)  # places of a text from which no window starts
    new[np.repeat(stop - np.cumsum(short), short) + np.arange(short.sum())] = False
    lo = np.flatnonzero(new)
    text = np.searchsorted(offs, lo, "right") - 1
    hi = np.minimum(np.append(lo[1:], len(q)), (offs[:-1] + room)[text]) - 1
    q = q[lo].astype(np.int64)
    return text, q, lo, hi, hashes[q]


def _least_places(hashes: np.ndarray) -> np.ndarray:
    """Place of the least of every SPAN neighbouring hashes (upper 40 bits; leftmost of equal ones), block by block in the processor's cache."""
    n = len(hashes) - SPAN + 1
    out = np.empty(n, np.uint32)
    for a in range(0, n, BLOCK):
        b = min(a + BLOCK, n)
        low = hashes[a:b + SPAN - 1] & ~_U((1 << 24) - 1)
        low |= np.arange(a, b + SPAN - 1, dtype=_U)
        size = 1
        while 2 * size <= SPAN:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        out[a:b] = np.minimum(low[:b - a], low[SPAN - size:SPAN - size + b - a]) & _U((1 << 24) - 1)
    return out


def _scanned(batches: Iterator[pa.RecordBatch]):
    """(batch, offs, text, q, lo, hi, anchor, bytes hash, whether the bytes came before in the text) of each slice.

    A slice longer than 2**24 bytes would lose places in the packed minimum, so
    a longer text is scanned in overlapping parts.
    """
    for batch in slices(batches, "text", SLICE_BYTES):
        data, offs = text_buffer(batch.column("text"))
        parts = []
        step = (1 << 24) - WINDOW
        for begin in range(0, max(len(data), 1), step):
            stop = min(begin + step + WINDOW - 1, len(data))
            part = data[begin:stop]
            prefix = prefix_hash(BYTE[part])
            border = np.clip(offs, begin, stop) - begin
            text, q, lo, hi, anchor = intervals(part, border, prefix)
            parts.append((text, q + begin, lo + begin, hi + begin, anchor, span_hash(prefix, lo, hi + WINDOW)))
        text, q, lo, hi, anchor, whole = (np.concatenate(x) for x in zip(*parts))
        again = np.ones(len(text), bool)
        again[np.unique(mix(whole + text.astype(_U) * _U(0x9E3779B97F4A7C15)), return_index=True)[1]] = False
        yield batch, offs, text, q, lo, hi, anchor, whole, again


def _anchor_counts(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, _, _, _, _, anchor, _, again in _scanned(batches):
            kinds, n = np.unique(anchor[~again], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(kinds.view(np.int64)), pa.array(n)], names=["anchor", "n"])

    return docs.select("text").mapInArrow(run, "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1").select("anchor")


def _marks(docs: DataFrame, table: np.ndarray) -> DataFrame:
    """Intervals with a possibly repeated anchor, and (``again``) those whose bytes came before in their document."""
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bits = (len(table) * 32).bit_length() - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, offs, text, q, lo, hi, anchor, whole, again in _scanned(batches):
            spot = mix(anchor) >> _U(64 - bits)
            there = ((shared.value[spot >> _U(5)] >> (spot & _U(31)).astype(np.uint32)) & 1).astype(bool) | again
            text, lo, hi, q, anchor, whole, again = (x[there] for x in (text, lo, hi, q, anchor, whole, again))
            row = pa.array(text)
            cols = [batch.column("doc").take(row), batch.column("th").take(row), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(lo - offs[text]), pa.array((hi - lo).astype(np.int32)), pa.array((q - lo).astype(np.int32)), pa.array(again)]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "th", "anchor", "whole", "lo", "more", "offset", "again"])

    return docs.select("doc", "th", "text").mapInArrow(run, "doc long, th long, anchor long, whole long, lo long, more int, offset int, again boolean")


def _cut(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes ``starts[i]:ends[i]`` as a binary column."""
    size = ends - starts
    offs = np.zeros(len(size) + 1, np.int32)
    np.cumsum(size, out=offs[1:])
    at = np.repeat(starts - offs[:-1], size) + np.arange(offs[-1])
    return pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offs), pa.py_buffer(data[at])])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Cut each listed interval of each text into slot pieces."""
    for batch in slices(batches, "text", SLICE_BYTES):
        data, offs = text_buffer(batch.column("text"))
        prefix = prefix_hash(BYTE[data])
        spans = batch.column("spans")
        text = np.repeat(np.arange(batch.num_rows), pc.list_value_length(spans).to_numpy())
        lo, more, offset = (x.to_numpy() for x in spans.flatten().flatten())
        q, least = offs[text] + lo + offset, offset - more
        for slot in range(0, SPAN, SLOT):
            a, z = np.maximum(least, slot), np.minimum(offset, slot + SLOT - 1)
            k = np.flatnonzero(a <= z)
            a, z, at, row = a[k].astype(np.int64), z[k].astype(np.int64), q[k], text[k]
            begin = at - slot
            core = mix(span_hash(prefix, begin, begin + CORE) + _U(slot + 1)).view(np.int64)
            doc, th = (batch.column(c).take(pa.array(row)) for c in ("doc", "th"))
            cols = [doc, th, pa.array(core), _cut(data, at - z, begin), _cut(data, begin + CORE, at - a + WINDOW), pa.array(at - z - offs[row]), pa.array((z - a).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc", "th", "key", "left", "right", "start", "extra"])


def _repeats(table: pa.Table) -> pa.Table:
    """Starts of windows that are not the first of their kind, by the suffix array of a bucket's pieces.

    Symbols: 0 ends the text, 1 ends a piece, 2 to 257 are bytes, then one for each core.
    """
    keys = {k: 258 + i for i, k in enumerate(dict.fromkeys(table.column("key").to_pylist()))}
    text: list[int] = []
    window: dict[int, tuple[int, int, int]] = {}
    for key, left, right, doc, th, start, extra in zip(*(table.column(c).to_pylist() for c in ("key", "left", "right", "doc", "th", "start", "extra"))):
        for i in range(extra + 1):
            window[len(text) + i] = (doc, th, start + i)
        text += [b + 2 for b in left]
        text.append(keys[key])
        text += [b + 2 for b in right]
        text.append(1)
    text.append(0)
    found: list[tuple[int, int, int]] = []
    run: list[tuple[int, int, int]] = []
    last: list[int] = []
    for i in [*(i for i in suffix_array(text) if i in window), None]:
        here = text[i:i + SLOT] if i is not None else None
        if here != last and run:
            found += sorted(run)[1:]
            run = []
        last = here
        if i is not None:
            run.append(window[i])
    doc, th, start = zip(*found) if found else ((), (), ())
    return pa.table({"doc": pa.array(doc, pa.int64()), "th": pa.array(th, pa.int64()), "a": pa.array(start, pa.int64()), "b": pa.array([s + WINDOW for s in start], pa.int64())})


def removed_ranges(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc, th, a, b): byte ranges to remove from documents (doc, th, text); they may overlap.

    Ranges are written as soon as they are known, and each working table is deleted once all that reads it is written.
    """
    counted = written(_anchor_counts(docs), "dedup-anchors", free=True)
    marks = written(_marks(docs, _mixed_table(counted)), "dedup-intervals", free=True)
    discard(counted)
    again = written(marks.where("again").selectExpr("doc", "th", "lo a", f"lo + more + {WINDOW} b"), "dedup-again")
    once = marks.where("not again")
    kinds = once.groupBy("anchor", "whole").agg(F.min(F.struct("doc", "th")).alias("top"))
    ranked = once.join(kinds, ["anchor", "whole"]).select("doc", "th", "anchor", "whole", "lo", "more", "offset", F.expr(_after("doc", "th")).alias("later"))
    ranked = written(ranked, "dedup-ranked", free=True)
    discard(marks)
    later = written(ranked.where("later").selectExpr("doc", "th", "lo a", f"lo + more + {WINDOW} b"), "dedup-later")
    least = ranked.where("not later")
    shared = least.groupBy("anchor").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high").select("anchor")
    spans = least.join(shared, "anchor").groupBy("doc", "th").agg(F.collect_list(F.struct("lo", "more", "offset")).alias("spans"))
    spans = written(spans, "dedup-spans", free=True)
    discard(ranked)
    texts = sieve(docs.select("doc", "th", "text"), "th", spans.select("th"))
    pieces = written(texts.join(spans, ["doc", "th"]).mapInArrow(_pieces, "doc long, th long, key long, left binary, right binary, start long, extra int"), "dedup-pieces", free=True)
    discard(spans)
    same = pieces.groupBy("key", "left", "right").agg(F.min(F.struct("doc", "th", "start")).alias("top"))
    first = written(same.select("key", "left", "right", "top.*", F.expr(f"length(left) + length(right) - {SLOT - 1}").cast("int").alias("extra")), "dedup-kinds", free=True)
    met = pieces.join(first.selectExpr("key", "left", "right", "struct(doc, th, start) as top"), ["key", "left", "right"])
    copies = written(met.where(_after("doc", "th", "start")).selectExpr("doc", "th", "start a", f"start + extra + {WINDOW} b"), "dedup-copies", free=True)
    discard(pieces)
    many = first.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    mixed = written(first.join(many, "key"), "dedup-mixed", free=True)
    discard(first)
    buckets = max(1, mixed.count() // BUCKET_PIECES)
    found = mixed.where(F.col("kinds") <= hot).groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket")).applyInArrow(_repeats, _RANGE)
    wide = mixed.where(F.col("kinds") > hot).select("key", "doc", "th", "left", "right", F.explode(F.expr("sequence(0, extra)")).alias("i"), "start")
    windows = wide.select("key", "doc", "th", (F.col("start") + F.col("i")).alias("start"), F.expr("substring(left, i + 1)").alias("l"), F.expr(f"substring(right, 1, {SLOT - 1} - length(left) + i)").alias("r"))
    head = windows.groupBy("key", "l", "r").agg(F.min(F.struct("doc", "th", "start")).alias("top"))
    spread = windows.join(head, ["key", "l", "r"]).where(_after("doc", "th", "start")).selectExpr("doc", "th", "start a", f"start + {WINDOW} b")
    rest = written(found.union(spread), "dedup-found", free=True)
    discard(mixed)
    return again.union(later).union(copies).union(rest)


def _mixed_table(counted: DataFrame) -> np.ndarray:
    """Bit table of repeated anchors, over the same mixed hash that ``_marks`` looks up.

    It has eight bits an anchor, up to 2**``TABLE_BITS`` (32 MiB). It only spares intervals
    the joins that follow; what passes it wrongly is alone with its anchor there.
    """
    size = min(TABLE_BITS, max(MIN_BITS, (8 * counted.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = mix(batch.column("anchor").to_numpy().view(_U)) >> _U(64 - size)
            word, at = np.unique((spot >> _U(5)).astype(np.int64), return_inverse=True)
            bits = np.zeros(len(word), np.int64)
            np.bitwise_or.at(bits, at, np.int64(1) << (spot & _U(31)).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits)], names=["word", "bits"])

    rows = counted.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    table = np.zeros((1 << size) // 32, np.uint32)
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy().astype(np.uint32)
    return table


def _kept(raw: bytes, ranges: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """(remaining bytes, removed bytes, maximal removed runs)."""
    out, at, removed, runs, end = [], 0, 0, 0, -1
    for a, b in sorted(ranges):
        if a > end:
            runs += 1
            out.append(raw[at:a])
            removed += b - a
            end = b
        elif b > end:
            removed += b - end
            end = b
        at = end
    out.append(raw[at:])
    return b"".join(out), removed, runs


def dedup(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of every row."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("doc"), F.coalesce("text", F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    ranges = removed_ranges(base, hot).groupBy("doc", "th").agg(F.collect_set(F.struct("a", "b")).alias("ranges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = [t.encode() for t in batch.column("text").to_pylist()]
            got = [_kept(r, [(x["a"], x["b"]) for x in spans or ()]) for r, spans in zip(raw, batch.column("ranges").to_pylist())]
            cols = [batch.column("doc_id"), pa.array([len(r) for r in raw], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.int64()), pa.array([hashlib.sha256(g[0]).hexdigest() for g in got], pa.string()), pa.array([g[0] for g in got], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return base.join(ranges, ["doc", "th"], "left").select("doc_id", "text", "ranges").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
