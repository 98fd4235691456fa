"""Quality: generalised additive model with pairwise interactions.

Plain numeric features of the whole text are cut into bins. Boosting goes round
the features in turn; each visit fits a shallow tree of one feature to the
logistic loss and adds it to that feature's lookup table. Then the feature
pairs that explain most of what is left are boosted the same way with trees of
two cuts into two-dimensional tables. A score is the sum of one table entry per
feature and pair, so scoring is bin look-up and addition.

The fit takes a bounded sample of labelled rows (``max_rows``; only their feature
numbers reach the driver); scoring runs over all documents.

Defined cases: a null or empty text has zero features and is scored like any
other; without training rows of both classes every score is the share of good
rows (0.5 without any); repeated rows are scored each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.labelled import held_out, labelled_sample
from prepcast.llm.text import BYTE, mix, per_text, prefix_hash, slices, span_hash, text_buffer, word_bounds, word_hashes

FEATURES = ("log_words", "word_length", "symbols", "digits", "capitals", "distinct_words", "top_word", "same_as_last", "repeated_trigrams", "repeated_lines", "ends_in_mark", "short_words", "words_a_line", "marks", "high_bytes", "byte_entropy")
MAX_ROWS = 20000
BINS, PAIR_BINS, PAIRS = 32, 8, 10
THRESHOLD = 0.7
_CLASS = {k: np.zeros(256, bool) for k in ("symbol", "digit", "upper", "mark", "lead", "letter")}
_CLASS["symbol"][list(b"#*$%&|<>@^~_=+\\/{}[]")] = True
_CLASS["digit"][48:58] = True
_CLASS["upper"][65:91] = True
_CLASS["letter"][65:91] = _CLASS["letter"][97:123] = _CLASS["letter"][128:] = True
_CLASS["mark"][list(b".,;:!?")] = True
_CLASS["lead"][:128] = _CLASS["lead"][192:] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True


def _distinct(keys: np.ndarray, text: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct keys, and the largest count of one key."""
    both = np.sort(mix(keys + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(24) | (text.astype(np.uint64) << np.uint64(40)))
    if not len(both):
        return np.zeros(texts), np.zeros(texts)
    start = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    size = np.diff(np.append(start, len(both)))
    owner = (both[start] >> np.uint64(40)).astype(np.int64)
    top = np.zeros(texts, np.int64)
    np.maximum.at(top, owner, size)
    return np.bincount(owner, minlength=texts).astype(float), top.astype(float)


def features(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text (at most 2**24 texts at once)."""
    texts = len(offs) - 1
    starts, ends, first = word_bounds(data, offs)
    count = np.diff(first).astype(float)
    some = np.maximum(count, 1)
    owner = np.repeat(np.arange(texts), np.diff(first))
    words = word_hashes(data, starts, ends)
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum(_CLASS["lead"][data], out=points[1:])
    chars = np.maximum(per_text(_CLASS["lead"][data], offs), 1)
    length = points[ends] - points[starts]
    kinds, top = _distinct(words, owner, texts)
    same = np.zeros(len(words), bool)
    same[1:] = (words[1:] == words[:-1]) & (owner[1:] == owner[:-1])
    n3 = np.maximum(np.diff(first) - 2, 0)
    own3 = np.repeat(np.arange(texts), n3)
    at3 = first[:-1][own3] + np.arange(len(own3)) - (np.cumsum(n3) - n3)[own3]
    tri, _ = _distinct(span_hash(prefix_hash(words), at3, at3 + 3), own3, texts)
    la, lb, lf = word_bounds(data, offs, _LINE)
    lines = np.diff(lf).astype(float)
    line_kinds, _ = _distinct(span_hash(prefix_hash(BYTE[data]), la, lb), np.repeat(np.arange(texts), np.diff(lf)), texts)
    letters = np.maximum(per_text(_CLASS["letter"][data], offs), 1)
    hist = np.bincount(np.repeat(np.arange(texts), np.diff(offs)) * 256 + data, minlength=texts * 256).reshape(texts, 256)
    p = hist / np.maximum(hist.sum(1, keepdims=True), 1)
    entropy = -(p * np.log2(np.where(p > 0, p, 1))).sum(1)
    cols = [np.log1p(count), per_text(length, first) / some, per_text(_CLASS["symbol"][data], offs) / chars, per_text(_CLASS["digit"][data], offs) / chars,
            per_text(_CLASS["upper"][data], offs) / letters, kinds / some, top / some, per_text(same, first) / some, 1 - tri / np.maximum(n3, 1), 1 - line_kinds / np.maximum(lines, 1),
            per_text(_CLASS["mark"][data[ends - 1]] if len(ends) else np.zeros(0, bool), first) / some, per_text(length <= 3, first) / some, count / np.maximum(lines, 1), per_text(_CLASS["mark"][data], offs) / chars,
            per_text(data > 127, offs) / np.maximum(np.diff(offs), 1), entropy]
    return np.stack(cols, 1)


@dataclass
class Model:
    bias: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.bias)
        for j, (edge, table) in enumerate(zip(self.edges, self.tables)):
            z += table[np.searchsorted(edge, x[:, j], "right")]
        if self.pairs:
            bins = [np.searchsorted(edge, x[:, j], "right") for j, edge in enumerate(self.coarse)]
            for a, b, table in self.pairs:
                z += table[bins[a], bins[b]]
        return 1 / (1 + np.exp(-z))


def _cut(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, int]:
    """Best gain and place of one cut of a histogram; 0 gain if none is allowed."""
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gr, hr = g.sum() - gl, h.sum() - hl
    gain = np.where((hl >= least) & (hr >= least), gl**2 / (hl + l2) + gr**2 / (hr + l2) - g.sum() ** 2 / (h.sum() + l2), 0.0)
    return (float(gain.max()), int(gain.argmax()) + 1) if len(gain) else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, l2: float, least: float, leaves: int = 3) -> np.ndarray:
    """Step values of a tree of at most ``leaves`` leaves on one binned feature."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_cut(g[a:b], h[a:b], l2, least), a, b) for a, b in parts]
        gain, at, a, b = max(options)
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = -g[a:b].sum() / (h[a:b].sum() + l2)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, l2: float, least: float) -> tuple[float, np.ndarray]:
    """Gain and step values of one cut along an axis and one cut of each side along the other."""
    best = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for at in range(1, len(gg)):
            out, gain = np.zeros_like(gg), 0.0
            for rows in (slice(0, at), slice(at, len(gg))):
                a, b = gg[rows].sum(0), hh[rows].sum(0)
                got, cut = _cut(a, b, l2, least)
                for cols in ((slice(0, cut), slice(cut, None)) if got > 0 else (slice(None),)):
                    s, t = a[cols].sum(), b[cols].sum()
                    out[rows, cols] = -s / (t + l2)
                    gain += s * s / (t + l2)
            if gain > best[0]:
                best = gain, out.T.copy() if flip else out
    return best


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 25, rate: float = 0.2, l2: float = 1.0, least: float = 5.0) -> Model:
    """Cyclic boosting of the single tables, then of the strongest pairs' tables."""
    if not len(y) or y.min() == y.max():
        p = min(max(float(y.mean()) if len(y) else 0.5, 1e-6), 1 - 1e-6)
        return Model(float(np.log(p / (1 - p))))
    f = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(f)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) for j in range(f)]
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(f)]
    model = Model(float(np.log(y.mean() / (1 - y.mean()))), edges, [np.zeros(len(e) + 1) for e in edges], [], coarse)
    z = np.full(len(y), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-z))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j in range(f):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins[j], g, len(edges[j]) + 1), np.bincount(bins[j], h, len(edges[j]) + 1), l2, least)
            model.tables[j] += step
            z += step[bins[j]]
    small = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(f)]
    width = PAIR_BINS + 1

    def grids(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        at = small[a] * width + small[b]
        return tuple(np.bincount(at, v, width * width).reshape(width, width) for v in (g, h))

    ranked = sorted(((_pair_tree(*grids(a, b), l2, least)[0], a, b) for a in range(f) for b in range(a)), reverse=True)[:PAIRS]
    model.pairs = [(a, b, np.zeros((width, width))) for _, a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            step = rate * _pair_tree(*grids(a, b), l2, least)[1]
            table += step
            z += step[small[a], small[b]]
    return model


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in slices(batches, "text", 4 << 20):
        yield batch, features(*text_buffer(batch.column("text")))


def train(docs: DataFrame, labels: DataFrame, folds: int = 4, held: int = 2, max_rows: int = MAX_ROWS, label: str = "quality") -> Model:
    sample = labelled_sample(docs, labels, label, folds, held, max_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _measured(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("y"), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["doc_id", "y", "x"])

    got = sample.mapInArrow(run, "doc_id long, y int, x array<double>").toArrow().sort_by("doc_id")
    x = np.array(got.column("x").to_pylist(), float).reshape(got.num_rows, len(FEATURES))
    return fit(x, got.column("y").to_numpy().astype(float))


def score(docs: DataFrame, model: Model, folds: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x in _measured(batches):
            s = shared.value.score(x)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds, held).alias("held_out"), "text")
    return base.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
