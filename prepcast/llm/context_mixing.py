"""Language-model scoring by online logistic context mixing.

A text is its bytes (A-Z as a-z) and an end symbol. Each symbol's eight bits are
predicted in turn. The predictor of order o knows how often a 0 and a 1 followed
the last o bytes and the bits already known in the training texts; its estimate
falls back on the next shorter order's where little was seen. The predictors' log
odds are added with weights; a gate (how much the three longest contexts have seen)
picks the weight set. The mixed odds are refined by an adaptive map from (known
bits, odds) to what was seen. The sum of the bits' log probabilities is the text's.

Counts are exact and grow with the texts. Distinct windows of REACH + 1 bytes are
dealt by their last NEAR context bytes to buckets, whose number follows the texts'
size; so a bucket holds all that was seen after each of its contexts of NEAR and
more bytes. The counts of shorter contexts (2**24 at most) are shared. To be scored,
slices of documents send their distinct windows to the buckets and get each one's
log probability back: a window is scored once, however many slices hold it. Slices
are larger than what a task handles at once (a part), so that fewer windows travel.

Everything is learnt from all training texts as Spark jobs. Weights are learnt
online, batch after batch, in every partition from common starting weights and
then averaged, twice; each window is left out of the counts that predict it.

The unigram base works on words (runs of bytes other than ``\\x20 \\x09-\\x0D``) and
an end token. Word counts are joined by word hash to the distinct words of slices
of documents, so a word crosses the network once per slice, not once per text.

Defined cases: a null or empty text is just its end; repeated rows are learnt and
scored each; without training texts counts are 0 (base: log10(0.1 / 0.1) = 0 per
token) and every bit has odds 1:1; a null doc_id counts as training; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prepcast.llm.labelled import held_out
from prepcast.llm.scratch import discard, small_batches, written
from prepcast.llm.text import LOWER, SPACE, mix, per_text, slices, text_buffer, trimmed, word_bounds, word_hashes

ORDERS = (1, 2, 3, 4, 5, 7)
REACH = max(ORDERS)
ALWAYS = 3
NEAR = 3
SLOT_BITS = 22
GATES = 27
PRIOR = np.float32(0.5)
BUCKETS = 33
SLICE_BYTES, LEARN_BYTES, ASK_BYTES, BASE_BYTES = 18_000_000, 4_000_000, 1_500_000, 2_000_000
BLOCK_BYTES = 1 << 18  # of texts whose windows are made at once, in the cache
BUCKET_BYTES, LEAST_BUCKETS = 12_000_000, 24
CHUNK_GRAMS = 200_000
END_TOKEN = 0x1E0F7A11
_U = np.uint64
_ODD = np.random.default_rng(77).integers(0, 2**63, len(ORDERS), dtype=np.uint64) * _U(2) + _U(1)
#: A slot's counts are kept as one byte each: exact to 32, then in steps of 1/8 octave.
_VALUE = np.concatenate([np.arange(33), 32 * 2.0 ** (np.arange(1, 224) / 8)]).astype(np.float32)
_N0, _N1 = np.repeat(_VALUE, 256), np.tile(_VALUE, 256)


def windows(data: np.ndarray, offs: np.ndarray, always: int = ALWAYS) -> tuple[np.ndarray, np.ndarray]:
    """(window of each symbol, first): the REACH bytes before it and itself, with an end (0) after each text.

    Bytes before the start of the text, and bytes beyond the ``always``-th that lie
    before the current word and its separator, are 0.
    """
    texts = len(offs) - 1
    size = np.diff(offs)
    begin = offs[:-1] + np.arange(texts) * (REACH + 1)
    line = np.zeros(len(data) + texts * (REACH + 1), np.uint8)
    place = np.arange(len(data)) + np.repeat(begin + REACH - offs[:-1], size)
    line[place] = LOWER[data]
    n = max(len(line) - REACH, 0)
    key = np.ndarray((n,), "<u8", line, strides=(1,)).byteswap() if n else np.zeros(0, _U)  # eight bytes from each place on
    if always < REACH:
        gap, inside = SPACE[line], np.ones(n, bool)
        for j in range(1, REACH + 1):
            if j > always:
                key &= ~np.where(inside, _U(0), _U(255 << 8 * j))
            inside &= ~gap[REACH - j:REACH - j + n]
    real = np.ones(n, bool)
    for j in range(REACH):  # windows that end in the next text's padding
        real[begin[1:] - REACH + j] = False
    return key[real], np.concatenate([[0], np.cumsum(size + 1)])


def _slots(key: np.ndarray, which: int, bit: int) -> np.ndarray:
    """Slot of the ``which``-th order for the bit after the symbol's higher bits."""
    node = _U(1 << (7 - bit)) | ((key & _U(255)) >> _U(bit + 1))
    ctx = (key >> _U(8)) & _U((1 << 8 * ORDERS[which]) - 1)
    return (((ctx << _U(8)) | node) * _ODD[which] >> _U(64 - SLOT_BITS)).astype(np.int64) + (which << SLOT_BITS)


def turned(key: np.ndarray) -> np.ndarray:
    """Windows with the nearest context byte on top and the symbol last: sorted, equal contexts of any order are neighbours."""
    back = key.byteswap()
    return back << _U(8) | back >> _U(56)


def context(turn: np.ndarray, order: int) -> np.ndarray:
    """The last ``order`` bytes and the symbol of turned windows."""
    return turn >> _U(64 - 8 * order) << _U(8) | turn & _U(255)


def summed(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their counts."""
    order = np.argsort(key)
    key, n = key[order], n[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[at], np.add.reduceat(n, at) if len(at) else n


def path_counts(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For 0 to 8 known bits of the symbol: how often the key's context was followed by a symbol with these bits."""
    before = np.concatenate([[0], np.cumsum(n)])
    out = np.empty((9, len(key)), np.float32)
    for k in range(9):
        part = key >> _U(8 - k)
        at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        to = np.append(at[1:], len(key))
        out[k] = np.repeat(before[to] - before[at], to - at)
    return out


def shared_counts(key: np.ndarray, n: np.ndarray, want: np.ndarray) -> np.ndarray:
    """``path_counts`` of the keys in ``want``, which ``key`` need not hold."""
    before = np.concatenate([[0], np.cumsum(n)])
    out = np.empty((9, len(want)), np.float32)
    for k in range(9):
        least = want >> _U(8 - k) << _U(8 - k)
        out[k] = before[np.searchsorted(key, least + _U(1 << 8 - k))] - before[np.searchsorted(key, least)]
    return out


Found = tuple[np.ndarray, np.ndarray]


@dataclass
class Model:
    """Mixing over counts in hashed slots; ``Exact`` takes them from whole contexts."""

    table: np.ndarray  # per slot: packed count of 0s and of 1s
    weights: np.ndarray  # gate x (orders + bias)
    refined: np.ndarray | None = None  # known bits x bucket -> odds

    def find(self, key: np.ndarray) -> Found:
        return key, key

    def counts(self, found: Found, which: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        cell = self.table[_slots(found[0], which, bit)]
        return _N0[cell], _N1[cell]

    def inputs(self, found: Found, bit: int, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """(log odds of each predictor and a constant, gate); ``seen`` is the true bit to leave out of the counts."""
        size = len(found[0])
        odds = np.ones((len(ORDERS) + 1, size), np.float32)
        gate, p = np.zeros(size, np.int64), np.full(size, 0.5, np.float32)
        for which in range(len(ORDERS)):
            n0, n1 = self.counts(found, which, bit)
            if seen is not None:
                n0, n1 = np.maximum(n0 - ~seen, 0), np.maximum(n1 - seen, 0)
            total = n0 + n1
            p = np.clip((n1 + PRIOR * p) / (total + PRIOR), 1e-5, 1 - 1e-5)
            odds[which] = np.log(p / (1 - p))
            if which >= len(ORDERS) - 3:
                gate = gate * 3 + (total >= 1) + (total >= 4)
        return odds, gate

    def mixed(self, odds: np.ndarray, gate: np.ndarray) -> np.ndarray:
        return np.einsum("ij,ji->j", odds, self.weights[gate])

    def place(self, key: np.ndarray, bit: int, z: np.ndarray) -> np.ndarray:
        node = (1 << (7 - bit)) | (key & _U(255)).astype(np.int64) >> (bit + 1)
        return node * BUCKETS + np.rint((np.clip(z, -8, 8) + 8) * 2).astype(np.int64)

    def log10(self, key: np.ndarray) -> np.ndarray:
        """log10 probability of each window's symbol."""
        total, found = np.zeros(len(key)), self.find(key)
        for bit in range(7, -1, -1):
            z = self.mixed(*self.inputs(found, bit, None))
            p = 1 / (1 + np.exp(-z))
            if self.refined is not None:
                p = 0.5 * p + 0.5 * self.refined[self.place(key, bit, z)]
            p = np.clip(p, 1e-6, 1 - 1e-6)
            one = (key >> _U(bit)) & _U(1) == 1
            total += np.log10(np.where(one, p, 1 - p))
        return total


Shared = dict[int, tuple[np.ndarray, np.ndarray]]


class Exact(Model):
    """Mixing over the exact counts of turned windows; ``table`` holds (contexts with symbols, path counts) of each order."""

    def learn(self, turn: np.ndarray, n: np.ndarray, shared: Shared) -> None:
        """Take the counts of sorted turned windows, all there are of their NEAR-byte contexts."""
        self.table = []
        for order in ORDERS:
            key = context(turn, order)
            if order < NEAR:
                key = np.unique(key)
                self.table.append((key, shared_counts(*shared[order], key)))
            else:
                key, sums = (key, n) if order == REACH else summed(key, n)
                self.table.append((key, path_counts(key, sums)))

    def find(self, key: np.ndarray) -> Found:
        at = [np.searchsorted(kinds, context(key, order)) for order, (kinds, _) in zip(ORDERS, self.table)]
        return key, np.array(at, np.int32)

    def counts(self, found: Found, which: int, bit: int) -> tuple[np.ndarray, np.ndarray]:
        key, at = found[0], found[1][which]
        path = self.table[which][1]
        both, same = path[7 - bit][at], path[8 - bit][at]
        n1 = np.where((key >> _U(bit)) & _U(1) == 1, same, both - same)
        return both - n1, n1


def packed(values: np.ndarray) -> bytes:
    """zstandard of the values' bytes, all first bytes first."""
    import zstandard

    return zstandard.compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, values.itemsize).T).tobytes(), 1) if len(values) else b""


def unpacked(raw: pa.Scalar, kind: type) -> np.ndarray:
    import zstandard

    flat = np.frombuffer(zstandard.decompress(raw.as_buffer()) if len(raw.as_buffer()) else b"", np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, len(flat) // np.dtype(kind).itemsize).T).view(kind).ravel()


def chunks(turn: np.ndarray) -> Iterator[slice]:
    """Sorted turned windows in pieces of about CHUNK_GRAMS that keep NEAR-byte contexts whole."""
    near = turn >> _U(64 - 8 * NEAR)
    ends = np.append(np.flatnonzero(near[1:] != near[:-1]) + 1, len(turn))
    at = 0
    while at < len(turn):
        to = int(ends[min(np.searchsorted(ends, at + CHUNK_GRAMS), len(ends) - 1)])
        yield slice(at, to)
        at = to


def dealt(turn: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, buckets there, first): windows sorted by bucket, as they were within one."""
    near = turn >> _U(64 - 8 * NEAR)
    at = np.flatnonzero(np.concatenate([[True], near[1:] != near[:-1]])) if len(turn) else np.zeros(0, np.int64)
    size, bucket = np.diff(np.append(at, len(turn))), mix(near[at]) % _U(buckets)  # of each run of one context
    del near
    n = np.bincount(bucket.astype(np.int64), size, buckets).astype(np.int64)
    order = np.argsort(np.repeat(bucket.astype(np.min_scalar_type(buckets)), size), kind="stable")
    kinds = np.flatnonzero(n)
    return order, kinds, np.concatenate([[0], np.cumsum(n[kinds])])


def _texts(docs: DataFrame) -> DataFrame:
    """One row per slice of documents (doc_id, h, held_out, text): ids, lengths and the packed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", SLICE_BYTES):
            data, offs = text_buffer(batch.column("text"))
            lists = [pa.array([batch.column(c)], pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("h", pa.int64()), ("held_out", pa.bool_()))]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *lists, pa.array([np.diff(offs)], pa.list_(pa.int64())), pa.array([len(data)]), pa.array([packed(data)], pa.binary())], names=["slice", "docs", "hs", "held", "sizes", "bytes", "data"])
            number += 1

    return docs.mapInArrow(run, "slice long, docs array<long>, hs array<long>, held array<boolean>, sizes array<long>, bytes long, data binary")


Part = tuple[np.ndarray, np.ndarray, slice]


def _cut(offs: np.ndarray, most: int) -> Iterator[slice]:
    """Texts of ``most`` bytes together, or one longer text."""
    at = 0
    while at < len(offs) - 1:
        to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, "right")) - 1)
        yield slice(at, to)
        at = to


def _parts(sizes: pa.Scalar, data: pa.Scalar, most: int) -> list[Part]:
    """(bytes, borders, documents) of a slice's parts: texts of ``most`` bytes together, or one longer text."""
    offs = np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)
    text = unpacked(data, np.uint8)
    return [(text[offs[x.start]:offs[x.stop]], offs[x.start:x.stop + 1] - offs[x.start], x) for x in _cut(offs, most)]


def _windows_of(part: Part, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(turned windows, first) of a part (windows of the documents in ``keep``), made block by block: only these stay."""
    data, offs, docs = part
    first = offs + np.arange(len(offs))
    out, at = np.empty(first[-1], _U), 0
    for x in _cut(offs, BLOCK_BYTES):
        turn = turned(windows(data[offs[x.start]:offs[x.stop]], offs[x.start:x.stop + 1] - offs[x.start], REACH)[0])
        if keep is not None:
            turn = turn[np.repeat(keep[docs][x], np.diff(first[x.start:x.stop + 1]))]
        out[at:at + len(turn)] = turn
        at += len(turn)
    return out[:at], first


def _distinct(part: Part, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a part (of the documents in ``keep``) in order, and how often each is there."""
    turn, _ = _windows_of(part, keep)
    turn.sort()
    at = np.flatnonzero(np.concatenate([[True], turn[1:] != turn[:-1]])) if len(turn) else np.zeros(0, np.int64)
    size, turn = len(turn), turn[at]
    return turn, np.diff(at, append=size)


def _ranked(part: Part) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct windows of a part in order, place of each symbol's window among them, first)."""
    turn, first = _windows_of(part)
    place = np.argsort(turn)
    turn = turn[place]
    new = np.concatenate([[True], turn[1:] != turn[:-1]])
    rank = np.empty(len(turn), np.uint32)
    rank[place] = np.cumsum(new, dtype=np.uint32) - np.uint32(1)
    return turn[new], rank, first


@dataclass
class Dealt:
    """Distinct windows of a part by bucket: bucket b has ``turn[border[b]:border[b + 1]]``, in order."""

    turn: np.ndarray
    border: np.ndarray

    @classmethod
    def of(cls, turn: np.ndarray, buckets: int) -> tuple[Dealt, np.ndarray]:
        """The windows by bucket, and where each was before."""
        order, kinds, first = dealt(turn, buckets)
        border = np.zeros(buckets + 1, np.int64)
        border[kinds + 1] = np.diff(first)
        return cls(turn[order], np.cumsum(border)), order

    def place(self, bucket: int) -> slice:
        return slice(self.border[bucket], self.border[bucket + 1])


def _asked(parts: list[Dealt], bucket: int) -> np.ndarray:
    """Distinct windows of a slice, given as its parts, in a bucket: what the slice asks of it, in order."""
    return np.unique(np.concatenate([p.turn[p.place(bucket)] for p in parts]))


def _sent(texts: DataFrame, buckets: int, training: bool) -> DataFrame:
    """(bucket, slice, grams, n): distinct windows, of the training documents of each part or of all of a slice."""

    def rows(kinds: np.ndarray, number: pa.Scalar, grams: list[bytes], n: list[bytes]) -> pa.RecordBatch:
        cols = [pa.array(kinds), pa.array(np.full(len(kinds), number.as_py())), pa.array(grams, pa.binary()), pa.array(n, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names=["bucket", "slice", "grams", "n"])

    def counted(part: Part, keep: np.ndarray, number: pa.Scalar) -> pa.RecordBatch:
        turn, n = _distinct(part, keep)  # none of this outlives the part
        order, kinds, first = dealt(turn, buckets)
        places = [order[a:b] for a, b in zip(first, first[1:])]
        return rows(kinds, number, [packed(turn[p]) for p in places], [packed(n[p]) for p in places])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trimmed()
        for batch in batches:
            for number, sizes, held, data in zip(*(batch.column(c) for c in ("slice", "sizes", "held", "data"))):
                if training:
                    keep = ~held.values.to_numpy(zero_copy_only=False).astype(bool)
                    for part in _parts(sizes, data, LEARN_BYTES):
                        yield counted(part, keep, number)
                        trimmed()
                else:  # bucket by bucket: all of a large slice's windows are held once, as its parts have them
                    parts = [Dealt.of(_distinct(part)[0], buckets)[0] for part in _parts(sizes, data, ASK_BYTES)]
                    kinds = np.flatnonzero(sum(np.diff(p.border) for p in parts))
                    grams = [packed(_asked(parts, b)) for b in kinds]
                    del parts
                    yield rows(kinds, number, grams, [b""] * len(kinds))
                    trimmed()

    return texts.mapInArrow(run, "bucket long, slice long, grams binary, n binary")


def _grams(sent: DataFrame) -> DataFrame:
    """(bucket, grams, n): each bucket's distinct windows with their counts in all training texts."""

    def merge(part: pa.Table) -> pa.Table:
        turn, n = summed(np.concatenate([unpacked(x, _U) for x in part.column("grams")]), np.concatenate([unpacked(x, np.int64) for x in part.column("n")]))
        return pa.table({"bucket": part.column("bucket")[:1], "grams": pa.array([packed(turn)], pa.binary()), "n": pa.array([packed(n)], pa.binary())})

    return sent.drop("slice").groupBy("bucket").applyInArrow(merge, "bucket long, grams binary, n binary")


def _each(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for grams, n in zip(batch.column("grams"), batch.column("n")):
            yield unpacked(grams, _U), unpacked(n, np.int64)


def _shared(grams: DataFrame) -> Shared:
    """Counts of the contexts shorter than NEAR bytes with their symbols; at most 2**24 rows are collected."""
    longest = max(o for o in ORDERS if o < NEAR)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for turn, n in _each(batches):
            key, n = summed(context(turn, longest), n)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    rows = grams.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    key, n = rows.column("key").to_numpy().view(_U), rows.column("n").to_numpy()
    return {o: summed(key >> _U(8 * (longest - o + 1)) << _U(8) | key & _U(255), n) for o in ORDERS if o < NEAR}


@dataclass
class Learnt:
    """Weights and map travel with each job, the shared counts are broadcast once; all longer contexts stay in ``grams``."""

    grams: DataFrame
    shared: Broadcast
    weights: np.ndarray
    refined: np.ndarray | None = None

    def maker(self):
        """What makes the model on an executor (a DataFrame can't travel)."""
        shared, weights, refined = self.shared, self.weights, self.refined
        return lambda: (Exact([], weights.copy(), refined), shared.value)


def _learn_weights(learnt: Learnt, rate: float, batch_rows: int = 4096) -> np.ndarray:
    """One online pass in every partition from the weights so far; the partitions' weights averaged by bits seen in each gate."""
    make = learnt.maker()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shared = make()
        bits, squares = np.zeros(GATES), np.full(own.weights.shape, 1e-9)
        for turn, counts in _each(batches):
            for piece in chunks(turn):
                own.learn(turn[piece], counts[piece], shared)
                whole, ats = own.find(turn[piece])
                order = np.random.default_rng(len(whole)).permutation(len(whole))  # neighbours share contexts: not one after the other
                for at in range(0, len(order), batch_rows):
                    rows = order[at:at + batch_rows]
                    key, n = whole[rows], counts[piece][rows].astype(float)
                    found = key, ats[:, rows]
                    for bit in range(7, -1, -1):
                        one = (key >> _U(bit)) & _U(1) == 1
                        odds, gate = own.inputs(found, bit, one)
                        err = (one - 1 / (1 + np.exp(-own.mixed(odds, gate)))) * n
                        step = np.stack([np.bincount(gate, err * odds[i], GATES) for i in range(len(ORDERS) + 1)], 1)
                        squares += step * step
                        own.weights += rate * step / np.sqrt(squares)
                        bits += np.bincount(gate, n, GATES)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(GATES)), pa.array(bits), pa.array((own.weights * bits[:, None]).tolist(), pa.list_(pa.float64()))], names=["gate", "bits", "w"])

    sums = [F.sum(F.element_at("w", i + 1)).alias(f"w{i}") for i in range(len(ORDERS) + 1)]
    out = learnt.weights.copy()
    for row in learnt.grams.mapInArrow(run, "gate long, bits double, w array<double>").groupBy("gate").agg(F.sum("bits").alias("bits"), *sums).collect():
        if row["bits"]:
            out[row["gate"]] = [row[f"w{i}"] / row["bits"] for i in range(len(ORDERS) + 1)]
    return out


def _learn_map(learnt: Learnt, batch_rows: int = 65536) -> np.ndarray:
    """What followed each (known bits, mixed odds bucket), over all training windows."""
    make = learnt.maker()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, shared = make()
        zero, one_ = np.zeros(256 * BUCKETS), np.zeros(256 * BUCKETS)
        for turn, counts in _each(batches):
            for piece in chunks(turn):
                model.learn(turn[piece], counts[piece], shared)
                for i in range(piece.start, piece.stop, batch_rows):
                    j = min(i + batch_rows, piece.stop)
                    key, n = turn[i:j], counts[i:j].astype(float)
                    found = model.find(key)
                    for bit in range(7, -1, -1):
                        one = (key >> _U(bit)) & _U(1) == 1
                        at = model.place(key, bit, model.mixed(*model.inputs(found, bit, one)))
                        one_ += np.bincount(at, n * one, 256 * BUCKETS)
                        zero += np.bincount(at, n * ~one, 256 * BUCKETS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(256 * BUCKETS)), pa.array(zero), pa.array(one_)], names=["at", "zero", "one"])

    own = 1 / (1 + np.exp(-(np.arange(256 * BUCKETS) % BUCKETS / 2 - 8)))
    out = own.copy()
    for row in learnt.grams.mapInArrow(run, "at long, zero double, one double").groupBy("at").agg(F.sum("zero").alias("zero"), F.sum("one").alias("one")).collect():
        out[row["at"]] = (row["one"] + 4 * own[row["at"]]) / (row["zero"] + row["one"] + 4)
    return out


def train(texts: DataFrame, buckets: int, passes: int = 2) -> Learnt:
    """Learn from every text of ``texts`` that is not held out."""
    grams = written(_grams(_sent(texts, buckets, training=True)), "mixing-grams", free=True)
    weights = np.full((GATES, len(ORDERS) + 1), 0.15)
    weights[:, -2:] = 0.5, 0.0
    learnt = Learnt(grams, grams.sparkSession.sparkContext.broadcast(_shared(grams)), weights)
    for step in range(passes):
        learnt.weights = _learn_weights(learnt, 0.05 / (step + 1))
    learnt.refined = _learn_map(learnt)
    return learnt


def _bucket(asked: pa.ChunkedArray, known: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Distinct windows of a bucket, asked for or known, in order, and their counts; the slices' questions are unpacked one at a time."""
    if not len(asked):
        return np.zeros(0, _U), np.zeros(0, np.int64)
    seen = [(unpacked(x, _U), unpacked(n, np.int64)) for x, n in zip(known.column("grams"), known.column("n"))]
    turn, n = seen[0] if seen else (np.zeros(0, _U), np.zeros(0, np.int64))  # one row a bucket
    new, more, waiting = np.zeros(0, _U), [], 0
    for x in asked:
        want = unpacked(x, _U)
        if len(turn):
            want = want[turn[np.minimum(np.searchsorted(turn, want), len(turn) - 1)] != want]
        more.append(want)
        waiting += len(want)
        if waiting > max(len(new), CHUNK_GRAMS):
            new, more, waiting = np.unique(np.concatenate([new, *more])), [], 0
    new = np.unique(np.concatenate([new, *more]))
    at = np.searchsorted(turn, new)
    return np.insert(turn, at, new), np.insert(n, at, 0)


def _added(sizes: pa.Scalar, data: pa.Scalar, buckets: int, answered: pa.Table) -> np.ndarray:
    """The score of each text of a slice: its windows' answers, handed to the slice's parts bucket by bucket, summed."""
    parts, texts = [], []
    for part in _parts(sizes, data, ASK_BYTES):
        kinds, rank, first = _ranked(part)
        by_bucket, order = Dealt.of(kinds, buckets)
        parts.append(by_bucket)
        spot = np.empty(len(kinds), np.uint32)
        spot[order] = np.arange(len(kinds), dtype=np.uint32)
        texts.append((spot[rank], first))
    values = [np.empty(len(p.turn), np.float32) for p in parts]
    for bucket, value in zip(answered.column("bucket").to_pylist(), answered.column("values")):
        asked, value = _asked(parts, bucket), unpacked(value, np.float32)
        for p, own in zip(parts, values):
            own[p.place(bucket)] = value[np.searchsorted(asked, p.turn[p.place(bucket)])]
    return np.concatenate([np.add.reduceat(own[spot].astype(float), first[:-1]) for own, (spot, first) in zip(values, texts)])


def text_scores(texts: DataFrame, buckets: int, learnt: Learnt) -> DataFrame:
    """doc_id, h (text hash), score: the model's log10 probability of each text."""
    make = learnt.maker()

    def answer(asked: pa.Table, known: pa.Table) -> pa.Table:
        model, shared = make()
        turn, n = _bucket(asked.column("grams"), known)
        value = np.zeros(len(turn), np.float32)
        for piece in chunks(turn):
            model.learn(turn[piece], n[piece], shared)
            for i in range(piece.start, piece.stop, 65536):
                j = min(i + 65536, piece.stop)
                value[i:j] = model.log10(turn[i:j])
        values = [packed(value[np.searchsorted(turn, unpacked(x, _U))]) for x in asked.column("grams")]
        del model, shared, turn, n, value
        trimmed()
        return pa.table({"of": asked.column("slice"), "bucket": asked.column("bucket"), "values": pa.array(values, pa.binary())})

    def add(part: pa.Table, answered: pa.Table) -> pa.Table:
        score = _added(part.column("sizes")[0], part.column("data")[0], buckets, answered)
        trimmed()
        return pa.table({"doc_id": part.column("docs")[0].values, "h": part.column("hs")[0].values, "score": score})

    asked = _sent(texts, buckets, training=False).drop("n")
    answers = asked.groupBy("bucket").cogroup(learnt.grams.groupBy("bucket")).applyInArrow(answer, "of long, bucket long, values binary")
    with small_batches(texts.sparkSession, 4):
        scores = written(texts.drop("held", "bytes").groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(add, "doc_id long, h long, score double"), "mixing-scores", free=True)
    discard(learnt.grams)
    discard(texts)
    return scores


def base_scores(docs: DataFrame) -> DataFrame:
    """doc_id, h, held_out, n_tokens, n_known, train_tokens, base_score of every row of docs (doc_id, h, held_out, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", BASE_BYTES):
            data, offs = text_buffer(batch.column("text"))
            starts, ends, first = word_bounds(data, offs)
            words = np.insert(word_hashes(data, starts, ends), first[1:], _U(END_TOKEN))
            n = np.diff(first) + 1
            kinds, at = np.unique(words.view(np.int64), return_inverse=True)
            train = np.repeat(~np.array(batch.column("held_out").to_numpy(zero_copy_only=False), bool), n)
            count = np.bincount(at, train, len(kinds)).astype(np.int64)
            cols = [pa.array([number]), *(pa.array([batch.column(c)], pa.list_(t)) for c, t in (("doc_id", pa.int64()), ("h", pa.int64()), ("held_out", pa.bool_()))), pa.array([n], pa.list_(pa.int64())), pa.array([packed(at.astype(np.uint32))], pa.binary()), pa.array([kinds], pa.list_(pa.int64())), pa.array([count], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["slice", "docs", "hs", "held", "n", "at", "kinds", "counts"])
            number += 1

    parts = written(docs.mapInArrow(cut, "slice long, docs array<long>, hs array<long>, held array<boolean>, n array<long>, at binary, kinds array<long>, counts array<long>"), "mixing-slices", free=True)
    each = parts.select("slice", F.explode(F.arrays_zip("kinds", "counts")).alias("x")).select("slice", F.col("x.kinds").alias("kind"), F.col("x.counts").alias("c"))
    counts = written(each.groupBy("kind").agg(F.sum("c").alias("c")), "mixing-counts", free=True)
    known = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.expr("cast(c > 0 as long)")), F.lit(0)).alias("v")).first()
    tokens, kinds_seen = known["n"], known["v"]
    answers = each.select(F.col("slice").alias("of"), "kind").join(counts, "kind")

    def look(part: pa.Table, answer: pa.Table) -> pa.Table:
        c = answer.column("c").to_numpy()[np.argsort(answer.column("kind").to_numpy())]  # slices list their words in this order
        row = {k: part.column(k)[0] for k in ("docs", "hs", "held", "n")}
        n = np.array(row["n"].as_py())
        first = np.concatenate([[0], np.cumsum(n)])
        at = unpacked(part.column("at")[0], np.uint32)
        value = np.log10((c + 0.1) / (tokens + 0.1 * (kinds_seen + 1)))
        return pa.table({"doc_id": row["docs"].values, "h": row["hs"].values, "held_out": row["held"].values, "n_tokens": n, "n_known": per_text((c > 0)[at], first), "train_tokens": np.full(len(n), tokens), "base_score": per_text(value[at], first)})

    kinds = "doc_id long, h long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double"
    rows = written(parts.drop("kinds", "counts").groupBy("slice").cogroup(answers.groupBy("of")).applyInArrow(look, kinds), "mixing-base", free=True)
    discard(parts)
    discard(counts)
    return rows


def assess(docs: DataFrame, folds: int = 10, held: int = 0) -> DataFrame:
    """Base and model scores of every document; learnt from those outside the held-out fold."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(folds, held).alias("held_out"), "text").withColumn("h", F.xxhash64(F.coalesce("text", F.lit(""))))
    rows = base_scores(base)
    texts = written(_texts(base), "mixing-texts")
    buckets = max(LEAST_BUCKETS, (texts.agg(F.sum("bytes").alias("n")).first()["n"] or 0) // BUCKET_BYTES)
    learnt = train(texts, buckets)
    each = text_scores(texts, buckets, learnt)
    scores = each.groupBy("doc_id", "h").agg(F.max("score").alias("score")).selectExpr("doc_id as __doc", "h as __h", "score")
    joined = rows.join(scores, (F.col("h") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__doc")))
    return joined.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
