"""Toxicity: character n-gram linear classifier on naive Bayes log-count ratios.

A text's features are the distinct n-grams of 4, 6 and 8 code points of its whole text (A-Z as
a-z, white space as one kind), hashed into a fixed number of slots. Each slot's
scale is its log-count ratio r = log((p + a) / |p|) - log((n + a) / |n|) over toxic
and other training texts, drawn towards 0 by two standard errors so that rare n-grams
don't fit noise; a text is the vector of its slots' r at unit length,
and a logistic regression on these vectors gives the score.

The fit takes a bounded sample of labelled rows (``max_rows``) on the driver;
scoring runs over all documents with the two slot tables as the only shared data.

Defined cases: a null or empty text has no n-gram and gets the intercept's score;
without training rows of both classes every score is that of the
one class (near 0 without any); repeated rows are scored each; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.labelled import held_out, labelled_sample
from prepcast.llm.scratch import written
from prepcast.llm.text import LOWER, SPACE, mix, slices, text_buffer

SIZES = (4, 6, 8)
SLOT_BITS = 18
PART = 1 << 19  # code points whose n-grams are held at a time
BLOCK = 1 << 14  # code points hashed at a time
SHORT = 2000  # texts of fewer code points are sorted
MAX_ROWS = 6000
THRESHOLD = 0.5
_ODD = np.random.default_rng(13).integers(0, 2**63, 9, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLD = np.where(SPACE, 32, LOWER).astype(np.uint32)


@dataclass
class Model:
    ratio: np.ndarray
    weight: np.ndarray  # ratio * regression weight
    bias: float

    def score(self, slots: np.ndarray, first: np.ndarray) -> np.ndarray:
        z = _sums(self.weight[slots], first) / np.sqrt(np.maximum(_sums(self.ratio[slots] ** 2, first), 1e-12))
        return 1 / (1 + np.exp(-(z + self.bias)))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def _code_points(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of the texts, and the texts' borders among them."""
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    plain = points < 128
    points[plain] = _FOLD[points[plain]]
    before = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=before[1:])
    return points, before[offs]


def _slots_at(points: np.ndarray, begin: int, stop: int, sizes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """By size: the slots of the n-grams that start from ``begin`` to before ``stop``, as far as there are enough code points."""
    out = {k: np.empty(max(min(stop, len(points) - k + 1) - begin, 0), np.int64) for k in sizes}
    for a in range(begin, stop, BLOCK):  # blocks that stay in a core's cache
        b = min(a + BLOCK, stop)
        letters = points[a:b + max(sizes) - 1].astype(np.uint64)
        packed = letters
        for k in range(2, max(sizes) + 1):
            packed = packed[:-1] * _ODD[0]
            packed += letters[k - 1:]
            if k in sizes:
                n = min(len(packed), b - a)
                out[k][a - begin:a - begin + n] = (mix(packed[:n] * _ODD[k]) >> np.uint64(64 - SLOT_BITS)).view(np.int64)
            if not len(packed):
                break
    return out


def features(data: np.ndarray, offs: np.ndarray, sizes: tuple[int, ...] = SIZES) -> tuple[np.ndarray, np.ndarray]:
    """(slots, first): sorted distinct slots of each text; n-grams are made ``PART`` starts at a time.

    A long text's slots are marked in a table of all slots and read off in order; a short text's are sorted.
    """
    points, offs = _code_points(data, offs)
    border, count = offs.tolist(), np.zeros(len(offs), np.int64)
    marks, found, i = np.zeros(1 << SLOT_BITS, bool), [], 0
    for begin in range(0, len(points), PART):
        stop = min(begin + PART, len(points))
        slots = _slots_at(points, begin, stop, sizes)
        while i < len(border) - 1 and border[i] < stop:
            start, end = border[i], border[i + 1]
            a = max(start, begin) - begin
            parts = [slots[k][a:max(min(end - k + 1, stop) - begin, a)] for k in sizes]
            if start >= begin and end <= stop and end - start < SHORT:
                at = np.sort(np.concatenate(parts).astype(np.uint32))
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
            else:
                for x in parts:
                    marks[x] = True
                if end > stop:  # goes on in the next part
                    break
                at = np.flatnonzero(marks)
                marks[at] = False
            found.append(at.astype(np.uint32))
            count[i + 1] = len(at)
            i += 1
    return np.concatenate(found) if found else np.zeros(0, np.uint32), np.cumsum(count)


def ratios(toxic: np.ndarray, other: np.ndarray, n_toxic: int, n_other: int, alpha: float = 1.0, errors: float = 2.0) -> np.ndarray:
    """Log-count ratio of every slot from the texts holding it, less ``errors`` standard errors."""
    pos, neg = toxic + alpha, other + alpha
    ratio = np.log(pos / (n_toxic + 2 * alpha)) - np.log(neg / (n_other + 2 * alpha))
    return np.sign(ratio) * np.maximum(np.abs(ratio) - errors * np.sqrt(1 / pos + 1 / neg), 0)


def fit(texts: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, epochs: int = 12, rate: float = 0.5, l2: float = 1e-5, seed: int = 7) -> Model:
    """Adagrad over minibatches of the scaled unit vectors. ``texts``: slots with a ratio of each text."""
    size = len(ratio)
    norm = np.array([np.sqrt(max((ratio[t] ** 2).sum(), 1e-12)) for t in texts])
    w, b = np.ones(size), float(np.log(y.mean() / (1 - y.mean())))
    seen, seen_b, rng = np.full(size, 1e-8), 1e-8, np.random.default_rng(seed)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(y)), max(1, len(y) // 64)):
            row = np.repeat(np.arange(len(part)), [len(texts[i]) for i in part])
            j = np.concatenate([texts[i] for i in part])
            x = ratio[j] / norm[part][row]
            out = np.bincount(row, x * w[j], len(part)) + b
            err = (1 / (1 + np.exp(-out)) - y[part]) / len(part)
            grad = np.bincount(j, x * err[row], size) + l2 * w
            seen += grad * grad
            w -= rate * grad / np.sqrt(seen)
            seen_b += err.sum() ** 2
            b -= rate * err.sum() / np.sqrt(seen_b)
    return Model(ratio, ratio * w, float(b))


def train(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, max_rows: int = MAX_ROWS, label: str = "toxic") -> Model:
    """Fit on at most ``max_rows`` labelled rows.

    Slots are counted in Spark; the driver gets the counts (a fixed number of
    slots) and then only the slots of each text that have a ratio.
    """
    sample = written(labelled_sample(docs, labels, label, folds, held, max_rows), "toxicity-sample")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, 1 << SLOT_BITS), np.int64)
        for batch in slices(batches, "text", 1 << 20):
            slots, first = features(*text_buffer(batch.column("text")))
            y = np.repeat(batch.column("y").to_numpy(), np.diff(first))
            sums += np.stack([np.bincount(slots[y == k], minlength=1 << SLOT_BITS) for k in (0, 1)])
        at = np.flatnonzero(sums.sum(0))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[0, at]), pa.array(sums[1, at])], names=["slot", "other", "toxic"])

    rows = sample.groupBy("y").count().collect()
    n = {0: 0, 1: 0, **{r["y"]: r["count"] for r in rows}}
    if not n[0] or not n[1]:
        none = np.zeros(1 << SLOT_BITS)
        return Model(none, none, 30.0 if n[1] else -30.0)
    got = sample.mapInArrow(count, "slot long, other long, toxic long").groupBy("slot").agg(F.sum("other").alias("other"), F.sum("toxic").alias("toxic")).toArrow()
    sums = np.zeros((2, 1 << SLOT_BITS))
    sums[:, got.column("slot").to_numpy()] = got.column("other").to_numpy(), got.column("toxic").to_numpy()
    ratio = ratios(sums[1], sums[0], n[1], n[0])
    telling = sample.sparkSession.sparkContext.broadcast(ratio != 0)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            slots, first = features(*text_buffer(batch.column("text")))
            texts = [t[telling.value[t]].tobytes() for t in np.split(slots, first[1:-1])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(texts, pa.binary())], names=["doc_id", "y", "slots"])

    got = sample.mapInArrow(keep, "doc_id long, y int, slots binary").toArrow()
    order = np.lexsort((got.column("y").to_numpy(), got.column("doc_id").to_numpy()))
    texts = [np.frombuffer(x.as_buffer(), np.uint32) for x in got.column("slots")]
    return fit([texts[i] for i in order], got.column("y").to_numpy().astype(np.float64)[order], ratio)


def score(docs: DataFrame, model: Model, folds: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            s = shared.value.score(*features(*text_buffer(batch.column("text"))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds, held).alias("held_out"), "text")
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the model doesn't reject, all columns as they are."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            s = shared.value.score(*features(*text_buffer(batch.column("text"))))
            yield batch.filter(pa.array(s < threshold))

    return docs.mapInArrow(run, docs.schema)
