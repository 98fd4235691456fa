"""Mixture-controlled packing of documents into fixed windows by deficit round-robin.

Every source is a queue of its documents' ids in doc_id order. In each round a
queue is credited its quantum (its target share of a window); it sends the
whole ids its credit covers and keeps the fraction as its deficit for the next
round. Documents are cut freely, so after r of R rounds a queue of A ids has
sent exactly floor(A * r / R): the deficits carried through all windows and
partitions have this closed form, and each partition places its documents from
the per-source totals alone, without running the rounds before it. The sent ids
form one stream that is cut every ``window`` ids, so every sequence but the
last is full and holds each source's share to within a few ids.

Targets are the sources' own shares unless ``mixture`` gives weights; with
weights, a queue that runs out ends a phase, and the others share the next one
by their weights (sources without a weight come last, by size). No id is lost
or repeated.

Defined cases: a null text is an empty text; an empty document is its end id; a
null source is a queue of its own; repeated doc_ids are packed as often as they
come; an empty table gives no rows; other columns are ignored. The number of
sources is taken as bounded (their totals are sent to every task).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.scratch import TEXT_ROWS, partitions, small_batches, written
from prepcast.llm.text import slices, text_buffer
from prepcast.llm.tokens import encoder

WINDOW = 4096
SLICE_BYTES, SLICE_ROWS = 4 << 20, 1024  # of texts, and of encoded documents, that a worker handles at once
ENCODED = "pid int, inner long, queue string, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string"
NULL_QUEUE = "\x00"


def encode(docs: DataFrame, file: str, end_id: int) -> DataFrame:
    """Queues in order: documents dealt by (source, doc_id) range, so a large source spans many partitions."""
    base = docs.select(F.coalesce(F.col("source").cast("string"), F.lit(NULL_QUEUE)).alias("queue"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    ordered = base.repartitionByRange(partitions(docs.sparkSession), "queue", "doc_id").sortWithinPartitions("queue", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        pid, enc, end, at = TaskContext.get().partitionId(), encoder(file), np.array([end_id], "<u4").tobytes(), {}
        for batch in slices(batches, "text", SLICE_BYTES):
            data, offs = text_buffer(batch.column("text"))
            raw = data.tobytes()
            ids = [enc.ids(raw[a:b]) + end for a, b in zip(offs, offs[1:])]
            n = len(ids)
            small = [np.frombuffer(x, "<u4").astype("<u2").tobytes() if not enc.wide else x for x in ids]
            inner = []  # ids of the same queue before it in this partition
            for queue, x in zip(batch.column("queue").to_pylist(), ids):
                inner.append(at.get(queue, 0))
                at[queue] = inner[-1] + len(x) // 4
            cols = [pa.array(np.full(n, pid, np.int32)), pa.array(inner, pa.int64()), batch.column("queue"), batch.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(small, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["pid", "inner", "queue", "doc_id", "doc_tokens", "ids"])

    return ordered.mapInArrow(run, ENCODED)


def phases(totals: list[int], weights: list[float] | None) -> list[list[int]]:
    """Ids each queue sends in each phase. One phase with the natural shares; with weights a phase ends when a queue does."""
    if weights is None:
        return [list(totals)] if sum(totals) else []
    exact = [Fraction(w).limit_denominator(10**6) for w in weights]
    left, out = list(totals), []
    while any(left):
        live = [i for i, n in enumerate(left) if n and exact[i] > 0]
        if not live:
            out.append(left)
            break
        time = min(Fraction(left[i]) / exact[i] for i in live)
        sent = [min(left[i], int(time * exact[i])) if i in live else 0 for i in range(len(left))]
        out.append(sent)
        left = [a - b for a, b in zip(left, sent)]
    return out


class Plan:
    """Places queue positions in the stream; closed form of the deficit rounds."""

    def __init__(self, totals: list[int], weights: list[float] | None, window: int):
        self.window, self.parts, base, done = window, [], 0, [0] * len(totals)
        for sent in phases(totals, weights):
            size = sum(sent)
            rounds = -(-size // window)
            kind = np.int64 if rounds < 2**31 else object
            self.parts.append((base, list(done), sent, rounds, np.array([a // rounds for a in sent], kind), np.array([a % rounds for a in sent], kind)))
            base += size
            done = [a + b for a, b in zip(done, sent)]

    def pieces(self, queue: int, begin: int, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queue start, length, stream position) of the pieces of queue positions begin <= t < end."""
        found = []
        for base, done, sent, rounds, whole, rest in self.parts:
            a, b = max(begin, done[queue]) - done[queue], min(end, done[queue] + sent[queue]) - done[queue]
            if a >= b:
                continue
            r = np.arange(((a + 1) * rounds - 1) // sent[queue], (b * rounds - 1) // sent[queue] + 1).astype(whole.dtype)
            now = whole[None, :] * r[:, None] + rest[None, :] * r[:, None] // rounds
            then = whole[None, :] * (r + 1)[:, None] + rest[None, :] * (r + 1)[:, None] // rounds
            start, stop = np.maximum(now[:, queue], a), np.minimum(then[:, queue], b)
            place = base + then[:, :queue].sum(1) + now[:, queue:].sum(1) + start - now[:, queue]
            live = stop > start
            found.append((start[live] + done[queue], (stop - start)[live], place[live]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        start, length, place = (np.concatenate(x).astype(np.int64) for x in zip(*found))
        cuts = (place + length - 1) // self.window - place // self.window + 1
        row = np.repeat(np.arange(len(cuts)), cuts)
        k = np.arange(len(row)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
        left = np.maximum(place[row], (place[row] // self.window + k) * self.window)
        right = np.minimum((place + length)[row], (place[row] // self.window + k + 1) * self.window)
        return start[row] + left - place[row], right - left, left


def pack(docs: DataFrame, file: str, end_id: int = 2, window: int = WINDOW, mixture: dict[str, float] | None = None) -> DataFrame:
    """Pieces of all documents: where each lies in its document and in which sequence at which offset."""
    with small_batches(docs.sparkSession, TEXT_ROWS):
        table = written(encode(docs, file, end_id), "packing-ids")
    # a row per source and partition that holds it: partitions are ranges of sources, so partitions + sources rows at most
    sums = table.groupBy("queue", "pid").agg(F.sum("doc_tokens").alias("n")).collect()
    totals: dict[str, int] = {}
    bases: dict[tuple[str, int], int] = {}
    for r in sorted(sums, key=lambda r: (r["queue"].encode(), r["pid"])):
        bases[r["queue"], r["pid"]] = totals.get(r["queue"], 0)
        totals[r["queue"]] = bases[r["queue"], r["pid"]] + r["n"]
    names = list(totals)
    weights = None if mixture is None else [float(mixture.get(q, 0.0)) for q in names]
    plan = Plan([totals[q] for q in names], weights, window)
    number = {q: i for i, q in enumerate(names)}

    shared = table.sparkSession.sparkContext.broadcast((plan, number, bases))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, number, bases = shared.value
        for batch in (b.slice(i, SLICE_ROWS) for b in batches for i in range(0, b.num_rows, SLICE_ROWS)):
            queues, pids = batch.column("queue").to_pylist(), batch.column("pid").to_pylist()
            ids, n = batch.column("ids").to_pylist(), batch.column("doc_tokens").to_numpy()
            docs_ = batch.column("doc_id")
            first = batch.column("inner").to_numpy() + np.array([bases[k] for k in zip(queues, pids)], np.int64)
            at = 0
            while at < len(queues):  # documents that follow each other in their queue are placed together
                to = at + 1
                while to < len(queues) and queues[to] == queues[at] and first[to] == first[to - 1] + n[to - 1]:
                    to += 1
                yield placed(plan, number[queues[at]], queues[at], docs_.slice(at, to - at), first[at:to], n[at:to], ids[at:to])
                at = to

    return table.select("queue", "pid", "doc_id", "doc_tokens", "inner", "ids").mapInArrow(run, PIECES)


def placed(plan: Plan, queue: int, name: str, docs: pa.Array, first: np.ndarray, n: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
    """Pieces of consecutive documents of a queue, the first at queue position ``first[0]``."""
    start, length, place = plan.pieces(queue, int(first[0]), int(first[-1] + n[-1]))
    lo = np.searchsorted(first, start, "right") - 1
    hi = np.searchsorted(first, start + length - 1, "right") - 1
    row = np.repeat(np.arange(len(start)), hi - lo + 1)  # a piece is cut where a document ends
    doc = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(hi - lo + 1) - (hi - lo + 1), hi - lo + 1)
    left = np.maximum(start[row], first[doc])
    right = np.minimum(start[row] + length[row], first[doc] + n[doc])
    place = place[row] + left - start[row]
    joined = b"".join(ids)
    raw = memoryview(joined if len(joined) == 4 * int(n.sum()) else np.frombuffer(joined, "<u2").astype("<u4").tobytes())
    cuts = zip((4 * (left - first[0])).tolist(), (4 * (right - first[0])).tolist())
    crc = [zlib.crc32(raw[a:b]) for a, b in cuts]
    source = pa.array([None if name == NULL_QUEUE else name], pa.string()).take(pa.array(np.zeros(len(doc), np.int64)))
    cols = [docs.take(pa.array(doc)), *[pa.array(x, pa.int64()) for x in (left - first[doc], right - left, crc, n[doc], place // plan.window, place % plan.window)], source]
    return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PIECES.split(", ")])
