"""Hard-negative mining with rotated one-bit codes and exact integer scores.

A row's score for an anchor is the inner product of their integer vectors
(``floor(scale * x)`` of every component). For each anchor the best ``positives``
other rows of its label are found, and for each of these the best ``negatives`` rows of
other labels whose score lies between ``low`` and ``high`` percent of the positive's.

Codes. A vector is rotated by a fixed random orthogonal matrix and replaced by the
signs of its components; the code vector's stored alignment (its inner product with
the vector) makes it the nearest multiple of that code vector. What is left over is
coded again after another rotation, ``STAGES`` times, and the norm of the last
remainder is stored. An anchor is rotated alike and cut to ``PLANES`` bits a
component, so its inner product with a code is a few popcounts. By Cauchy and Schwarz
the exact score lies within |anchor| * |remainder| and the rounding of the planes of
that estimate. Only pairs whose interval reaches the best scores known so far (and,
for negatives, one of the anchor's windows) are scored in integers; no result
depends on the estimate.

Plan. Rows are coded where they are read and written in blocks of ``BLOCK``. The
anchors are the stated query set: they are dealt to groups of about ``GROUP``, the blocks
to slices, and each pair (group, slice) is one stream of the group's anchors followed by
the slice's blocks, of which a task holds a bounded number at a time. It sends
on at most ``positives`` (or ``positives * negatives``) rows an anchor, which are merged by anchor. Neither a
common label nor a common vector gathers rows in one place.

Defined cases: rows with a null label or vector, or a null or non-finite component, take no part;
shorter vectors count as padded with zeros; components beyond +-2**18 after scaling count as that
bound; rows with a null vec_id are no anchors and come last among ties; repeated rows count each on
their own (an anchor's "other rows" are those at another place in the table), ties between them have
equal results; an empty table or one without anchors gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prepcast.llm.scratch import partitions, written

STAGES, PLANES = 4, 6
BLOCK, GROUP, STEP = 64, 512, 2048
BOUND = 1 << 18
NO_ID = np.iinfo(np.int64).max
NONE = np.iinfo(np.int64).min
CODED = "rid long, n int, ids binary, labels binary, ints binary, codes binary, align binary, rest binary"
RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


class Coder:
    """Rotations for vectors of ``size`` components; signs, alignments and remainders of rows; bit planes of anchors."""

    def __init__(self, size: int):
        self.size = size
        self.words = -(-size // 64)
        self.width = 64 * self.words
        rng = np.random.default_rng(7)
        self.turn = np.linalg.qr(rng.standard_normal((self.width, self.width)))[0]
        self.flip = rng.integers(0, 2, (STAGES, self.width)) * 2.0 - 1.0
        self.unit = self.width**-0.5

    def padded(self, ints: np.ndarray) -> np.ndarray:
        return np.pad(ints.astype(np.float64), ((0, 0), (0, self.width - self.size)))

    def rows(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes n x STAGES x words, alignments n x STAGES, norm of the remainder n)."""
        left = self.padded(ints)
        codes, align = [], []
        for flip in self.flip:
            bits = (left * flip) @ self.turn >= 0
            sign = np.where(bits, self.unit, -self.unit)
            code = sign @ self.turn.T * flip
            a = np.einsum("ij,ij->i", left, code)
            left = left - a[:, None] * code
            codes.append(np.packbits(bits, axis=1, bitorder="little").view(np.uint64))
            align.append(a)
        return np.stack(codes, 1), np.stack(align, 1), np.sqrt(np.einsum("ij,ij->i", left, left))

    def anchors(self, ints: np.ndarray) -> tuple:
        """Per stage: (planes PLANES x n x words, smallest value, step, sum of the cut values, sum of rounding errors); norms."""
        full = self.padded(ints)
        stages = []
        for flip in self.flip:
            y = (full * flip) @ self.turn
            low = y.min(1)
            step = np.maximum((y.max(1) - low) / (2**PLANES - 1), 1e-12)
            u = np.rint((y - low[:, None]) / step[:, None]).astype(np.int64)
            cut = low[:, None] + step[:, None] * u
            planes = np.stack([np.packbits((u >> j) & 1 == 1, axis=1, bitorder="little").view(np.uint64) for j in range(PLANES)])
            stages.append((planes, low, step, cut.sum(1), np.abs(y - cut).sum(1)))
        return stages, np.sqrt(np.einsum("ij,ij->i", full, full))

    def interval(self, stages: list, norm: np.ndarray, who: np.ndarray, codes: np.ndarray, align: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(estimate, half width) of the scores of anchors ``who`` with the rows: the exact score lies between."""
        mid = np.zeros((len(who), len(codes)))
        half = np.outer(norm[who], rest)
        for k, (planes, low, step, total, wrong) in enumerate(stages):
            hits = np.zeros(mid.shape, np.uint32)
            ones = np.zeros(len(codes), np.int64)
            for w in range(self.words):
                word = codes[:, k, w]
                ones += np.bitwise_count(word)
                for j in range(PLANES):
                    hits += np.bitwise_count(planes[j, who, w][:, None] & word[None, :]).astype(np.uint32) << np.uint32(j)
            dot = 2.0 * (low[who, None] * ones[None, :] + step[who, None] * hits) - total[who, None]
            mid += dot * (align[:, k] * self.unit)[None, :]
            half += np.outer(wrong[who], np.abs(align[:, k]) * self.unit)
        return mid, half * (1 + 1e-9) + 1e-6 * (1 + np.abs(mid))


_CODERS: dict[int, Coder] = {}


def coder(size: int) -> Coder:
    if size not in _CODERS:
        _CODERS.clear()
        _CODERS[size] = Coder(size)
    return _CODERS[size]


def code_rows(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(vec_id, label, embedding) -> blocks of coded rows; ``rid`` is the place of a block's first row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, c = TaskContext.get().partitionId() << 40, coder(size)
        for batch in batches:
            vectors = batch.column("embedding")
            length = pc.list_value_length(vectors).to_numpy(zero_copy_only=False).astype(np.int64)
            flat = np.floor(scale * vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64))
            ints = np.zeros((len(length), size), np.int32)
            ints[np.repeat(np.arange(len(length)), length), np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = np.clip(flat, -BOUND, BOUND)
            ids = pc.fill_null(batch.column("vec_id"), NO_ID).to_numpy(zero_copy_only=False)
            labels = batch.column("label").to_numpy(zero_copy_only=False)
            out = []
            for a in range(0, len(length), BLOCK):
                b = min(a + BLOCK, len(length))
                codes, align, rest = c.rows(ints[a:b])
                out.append((rid + a, b - a, ids[a:b].tobytes(), labels[a:b].tobytes(), ints[a:b].tobytes(), codes.tobytes(), align.tobytes(), rest.tobytes()))
            rid += len(length)
            yield pa.RecordBatch.from_pylist([dict(zip(NAMES, x)) for x in out], schema=SCHEMA)

    return rows.mapInArrow(run, CODED)


NAMES = [c.split()[0] for c in CODED.split(", ")]
SCHEMA = pa.schema([pa.field(n, {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k]) for n, k in (c.split() for c in CODED.split(", "))])


def anchor_rows(coded: DataFrame, every: int) -> DataFrame:
    """(rid, vec_id, label, ints) of the rows whose vec_id ``every`` divides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rid, ids, labels, ints = [], [], [], []
            for r in batch.to_pylist():
                own = np.frombuffer(r["ids"], np.int64)
                width = len(r["ints"]) // r["n"]
                for i in np.flatnonzero((own % every == 0) & (own != NO_ID)):
                    rid.append(r["rid"] + int(i))
                    ids.append(int(own[i]))
                    labels.append(int(np.frombuffer(r["labels"], np.int64)[i]))
                    ints.append(r["ints"][i * width:(i + 1) * width])
            yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array(ints, pa.binary())], names=["rid", "vec_id", "label", "ints"])

    return coded.select("rid", "n", "ids", "labels", "ints").mapInArrow(run, "rid long, vec_id long, label long, ints binary")


class Best:
    """The ``k`` best (score, id, place) of each of ``n`` lists, as rows come."""

    def __init__(self, n: int, k: int):
        self.n, self.k = n, k
        self.which = self.score = self.id = self.rid = np.zeros(0, np.int64)
        self.least = np.full(n, NONE)  # the k-th best score of a full list

    def add(self, which: np.ndarray, score: np.ndarray, id_: np.ndarray, rid: np.ndarray) -> None:
        if not len(which):
            return
        which, score, id_, rid = (np.concatenate(x) for x in zip((self.which, self.score, self.id, self.rid), (which, score, id_, rid)))
        order = np.lexsort((rid, id_, -score, which))
        which = which[order]
        place = np.arange(len(which)) - np.searchsorted(which, which)
        kept = order[place < self.k]
        full = place == self.k - 1
        self.least[which[full]] = score[order][full]
        self.which, self.score, self.id, self.rid = which[place < self.k], score[kept], id_[kept], rid[kept]


class Group:
    """One stream: the anchors of a group, then blocks of rows; the best rows of each list at its end."""

    def __init__(self, size: int, positives: int, negatives: int, mining: bool):
        self.c, self.size, self.mining, self.k = coder(size), size, mining, negatives if mining else positives
        self.lists, self.parts, self.waiting, self.held = positives if mining else 1, [], [], 0
        self.best = None

    def anchor(self, r: dict) -> None:
        self.parts.append(r)

    def _ready(self) -> None:
        self.rid, self.ids, self.label = (np.array([p[c] for p in self.parts], np.int64) for c in ("rid", "vec_id", "label"))
        self.ints = np.frombuffer(b"".join(p["ints"] for p in self.parts), np.int32).reshape(-1, self.size)
        self.stages, self.norm = self.c.anchors(self.ints)
        self.best = Best(len(self.parts) * self.lists, self.k)
        if self.mining:  # a list without a positive has a window that nothing meets
            pad = lambda x, v: list(x) + [v] * (self.lists - len(x))
            self.low = np.array([pad(p["lows"], 1) for p in self.parts], np.int64)
            self.high = np.array([pad(p["highs"], 0) for p in self.parts], np.int64)

    def block(self, r: dict) -> None:
        self.waiting.append(r)
        self.held += r["n"]
        if self.held >= STEP:
            self.flush()

    def flush(self) -> None:
        if self.best is None:
            self._ready()
        if not self.waiting:
            return
        rs, self.waiting, self.held = self.waiting, [], 0
        get = lambda c, t: np.frombuffer(b"".join(r[c] for r in rs), t)
        ids, labels, ints = get("ids", np.int64), get("labels", np.int64), get("ints", np.int32).reshape(-1, self.size)
        codes, align, rest = get("codes", np.uint64).reshape(-1, STAGES, self.c.words), get("align", np.float64).reshape(-1, STAGES), get("rest", np.float64)
        rid = np.concatenate([r["rid"] + np.arange(r["n"], dtype=np.int64) for r in rs])
        if self.mining:
            for a in range(0, len(self.rid), 64):
                self._mine(np.arange(a, min(a + 64, len(self.rid))), np.arange(len(ids)), ids, labels, ints, codes, align, rest, rid)
            return
        for label in np.unique(self.label):
            rows, who = np.flatnonzero(labels == label), np.flatnonzero(self.label == label)
            for a in range(0, len(who) if len(rows) else 0, 64):
                self._rank(who[a:a + 64], rows, ids, ints, codes, align, rest, rid)

    def _score(self, who: np.ndarray, rows: np.ndarray, ints: np.ndarray) -> np.ndarray:
        out = np.zeros(len(who), np.int64)
        for a in range(0, len(who), 1 << 15):
            out[a:a + (1 << 15)] = np.einsum("ij,ij->i", self.ints[who[a:a + (1 << 15)]].astype(np.int64), ints[rows[a:a + (1 << 15)]].astype(np.int64))
        return out

    def _rank(self, who, rows, ids, ints, codes, align, rest, rid) -> None:
        mid, half = self.c.interval(self.stages, self.norm, who, codes[rows], align[rows], rest[rows])
        same = self.rid[who, None] == rid[rows][None, :]
        low = np.where(same, -np.inf, mid - half)
        reach = self.best.least[who].astype(np.float64)
        if len(rows) > self.k:
            reach = np.maximum(reach, np.partition(low, len(rows) - self.k, axis=1)[:, len(rows) - self.k])
        i, j = np.nonzero((mid + half >= reach[:, None]) & ~same)
        self.best.add(who[i], self._score(who[i], rows[j], ints), ids[rows[j]], rid[rows[j]])

    def _mine(self, who, rows, ids, labels, ints, codes, align, rest, rid) -> None:
        mid, half = self.c.interval(self.stages, self.norm, who, codes, align, rest)
        low, high = mid - half, mid + half
        least = np.maximum(self.best.least.reshape(-1, self.lists)[who], self.low[who])
        open_ = np.zeros(mid.shape, bool)
        for w in range(self.lists):
            open_ |= (high >= least[:, w, None]) & (low <= self.high[who, w, None])
        open_ &= self.label[who, None] != labels[None, :]
        i, j = np.nonzero(open_)
        score = self._score(who[i], rows[j], ints)
        for w in range(self.lists):
            fits = (score >= least[i, w]) & (score <= self.high[who[i], w])
            self.best.add(who[i[fits]] * self.lists + w, score[fits], ids[rows[j[fits]]], rid[rows[j[fits]]])

    def result(self) -> pa.RecordBatch:
        self.flush()
        b = self.best
        who, w = b.which // self.lists, b.which % self.lists
        cols = [self.rid[who], self.ids[who], w, b.id, b.rid, b.score]
        return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in cols], names=["anchor", "anchor_id", "list", "found_id", "found", "score"])


FOUND = "anchor long, anchor_id long, list long, found_id long, found long, score long"


def search(anchors: DataFrame, coded: DataFrame, groups: int, slices: int, size: int, positives: int, negatives: int, mining: bool) -> DataFrame:
    """The best rows of every anchor (``mining``: of every window) within every slice."""
    spark = coded.sparkSession
    head = anchors.select(F.pmod(F.xxhash64("rid"), F.lit(groups)).alias("grp"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.lit(0).alias("kind"), "rid", *[x for x in ("vec_id", "label", "lows", "highs") if x in anchors.columns], "ints")
    rest = coded.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("grp"), F.pmod(F.xxhash64("rid"), F.lit(slices)).cast("int").alias("slice"), F.lit(1).alias("kind"), *NAMES)
    both = head.unionByName(rest, allowMissingColumns=True)
    n = max(partitions(spark), min(groups * slices, 4 * partitions(spark)))
    stream = both.repartition(n, "grp", "slice").sortWithinPartitions("grp", "slice", "kind", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                for r in batch.slice(at, 256).to_pylist():
                    if (r["grp"], r["slice"]) != key:
                        if group is not None and group.parts:
                            yield group.result()
                        key, group = (r["grp"], r["slice"]), Group(size, positives, negatives, mining)
                    if r["kind"] == 0:
                        group.anchor(r)
                    elif group.parts:
                        group.block(r)
        if group is not None and group.parts:
            yield group.result()

    return stream.mapInArrow(run, FOUND)


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256) -> DataFrame:
    """Hard negatives of the anchors among ``rows`` (vec_id, label, embedding); see the module's text."""
    spark = rows.sparkSession
    base = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    base = base.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf")))))
    n, size = base.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    size = max(size or 1, 1)
    coded = written(code_rows(base, size, scale), "negatives-coded")
    anchors = written(anchor_rows(coded, every), "negatives-anchors")
    count = anchors.count()
    groups = max(1, -(-count // GROUP))
    slices = max(1, min(-(-2 * partitions(spark) // groups), n // 1024), n >> 22)

    first = search(anchors, coded, groups, slices, size, positives, negatives, False)
    by_anchor = Window.partitionBy("anchor").orderBy(F.desc("score"), "found_id", "found")
    top = written(first.withColumn("place", F.row_number().over(by_anchor)).where(F.col("place") <= positives), "negatives-positives")
    # 100 * negative must lie between low and high times the positive's score
    windows = top.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "found_id", "score"))).alias("p"))
    windows = windows.select(F.col("anchor").alias("rid"), F.expr(f"transform(p, x -> ({low} * x.score) div 100 + if(({low} * x.score) % 100 > 0, 1, 0))").alias("lows"), F.expr(f"transform(p, x -> ({high} * x.score) div 100 - if(({high} * x.score) % 100 < 0, 1, 0))").alias("highs"))
    second = search(anchors.join(windows, "rid"), coded, groups, slices, size, positives, negatives, True)
    by_list = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "found_id", "found")
    found = second.withColumn("place", (F.col("list") + 1).cast("int")).withColumn("rank", F.row_number().over(by_list)).where(F.col("rank") <= negatives)
    real = lambda c: F.when(F.col(c) != F.lit(int(NO_ID)), F.col(c))
    positive = top.select("anchor", "place", real("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(positive, ["anchor", "place"]).select("anchor_id", "positive_id", "rank", real("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
