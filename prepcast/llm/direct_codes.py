"""Token ids in directly addressable codes, readable at any position.

Each id is cut into 8-bit chunks, lowest first. Level 0 holds the first chunk
of every id; a continuation bitmap marks the ids that go on, and level k + 1
holds the next chunk of just those. A rank directory (set bits before every
512-bit block of the bitmap) gives an id's place on the next level, so one id
is read in a step per level without decoding its neighbours.

A store is a Parquet folder of blocks in ascending document order:
``shard, block`` (order of the blocks), ``n_tokens``, ``doc_ids``,
``doc_starts`` (n_docs + 1 local token borders) and ``levels``, an array of
``chunks, bits, ranks`` binaries. Spark's committer writes it, so a lost
executor's block is simply written again.

Defined cases: a null text is an empty text; an empty document has its end id
only; repeated doc_ids are stored as often as they come, in text order; a null
doc_id sorts first; an empty table gives an empty store; other columns are
ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prepcast.llm.scratch import partitions
from prepcast.llm.text import text_buffer
from prepcast.llm.tokens import encoder

RANK_BITS = 512
BLOCK_TOKENS = 1 << 20
LEVEL = "struct<chunks:binary,bits:binary,ranks:binary>"
BLOCK_SCHEMA = f"shard int, block int, n_tokens long, doc_ids array<long>, doc_starts array<long>, levels array<{LEVEL}>"
_LEVEL_PA = pa.struct([("chunks", pa.binary()), ("bits", pa.binary()), ("ranks", pa.binary())])
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode_levels(ids: np.ndarray) -> list[dict[str, bytes]]:
    """The levels of an array of non-negative ids below 2**32."""
    levels, rest = [], ids.astype(np.uint32)
    while len(rest) or not levels:
        more = rest > 255
        bits = np.packbits(more, bitorder="little")
        per = np.add.reduceat(_POP[bits].astype(np.uint32), np.arange(0, len(bits), RANK_BITS // 8)) if len(bits) else np.zeros(0, np.uint32)
        ranks = np.concatenate([[0], np.cumsum(per)[:-1]]).astype("<u4") if len(per) else per
        levels.append({"chunks": (rest & 255).astype(np.uint8).tobytes(), "bits": bits.tobytes(), "ranks": ranks.tobytes()})
        rest = rest[more] >> 8
    return levels


def _rank(bits: np.ndarray, ranks: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Set bits before each position: directory entry, then the bytes of one 512-bit block."""
    out = ranks[at // RANK_BITS].astype(np.int64)
    byte = at >> 3
    first = (at // RANK_BITS) * (RANK_BITS // 8)
    for k in range(RANK_BITS // 8):
        j = first + k
        live = j < byte
        if not live.any():
            break
        out += np.where(live, _POP[bits[np.minimum(j, len(bits) - 1)]], 0)
    return out + _POP[bits[byte] & ((1 << (at & 7)) - 1).astype(np.uint8)]


def access(levels: list[dict[str, bytes]], at: np.ndarray) -> np.ndarray:
    """The ids at the given positions, in any order, by rank steps alone."""
    out, live, shift = np.zeros(len(at), np.uint32), np.arange(len(at)), 0
    at = at.astype(np.int64)
    for level in levels:
        if not len(live):
            break
        chunks, bits, ranks = (np.frombuffer(level[k], t) for k, t in (("chunks", np.uint8), ("bits", np.uint8), ("ranks", "<u4")))
        out[live] |= chunks[at].astype(np.uint32) << np.uint32(shift)
        more = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        live, at = live[more], _rank(bits, ranks, at[more])
        shift += 8
    return out


def _rank_one(bits: bytes, ranks: bytes, at: int) -> int:
    """``_rank`` of one position."""
    block, byte = at // RANK_BITS, at >> 3
    if byte >= len(bits):
        return sum(int.from_bytes(bits[i:i + 64], "little").bit_count() for i in range(0, len(bits), 64))
    inside = int.from_bytes(bits[block * (RANK_BITS // 8):byte + 1], "little") & ((1 << (at % RANK_BITS)) - 1)
    return int.from_bytes(ranks[4 * block:4 * block + 4], "little") + inside.bit_count()


def access_range(levels: list[dict[str, bytes]], begin: int, end: int) -> np.ndarray:
    """The ids of begin <= position < end: one rank step a level, then neighbours in step."""
    out, live, shift = np.zeros(end - begin, np.uint32), None, 0
    for level in levels:
        if begin >= end:
            break
        part = np.frombuffer(level["chunks"], np.uint8, end - begin, begin).astype(np.uint32) << np.uint32(shift)
        if live is None:
            out[:] = part
        else:
            out[live] |= part
        bits = level["bits"]
        here = np.frombuffer(bits, np.uint8, ((end + 7) >> 3) - (begin >> 3), begin >> 3)
        more = np.flatnonzero(np.unpackbits(here, bitorder="little")[begin & 7:(begin & 7) + end - begin])
        live = more if live is None else live[more]
        begin = _rank_one(bits, level["ranks"], begin)
        end = begin + len(more)
        shift += 8
    return out


def _blocks(file: str, end_id: int, block_tokens: int):
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard, block, enc = TaskContext.get().partitionId(), 0, encoder(file)
        docs: list[int | None] = []
        starts, parts, size = [0], [], 0

        def flush() -> pa.RecordBatch:
            levels = encode_levels(np.frombuffer(b"".join(parts), "<u4"))
            cols = [pa.array([shard], pa.int32()), pa.array([block], pa.int32()), pa.array([size], pa.int64()), pa.array([docs], pa.list_(pa.int64())), pa.array([starts], pa.list_(pa.int64())), pa.array([levels], pa.list_(_LEVEL_PA))]
            return pa.RecordBatch.from_arrays(cols, names=["shard", "block", "n_tokens", "doc_ids", "doc_starts", "levels"])

        for batch in batches:
            data, offs = text_buffer(batch.column("text"))
            raw = data.tobytes()
            for i, doc in enumerate(batch.column("doc_id").to_pylist()):
                ids = enc.ids(raw[offs[i]:offs[i + 1]]) + end
                docs.append(doc)
                parts.append(ids)
                size += len(ids) // 4
                starts.append(size)
                if size >= block_tokens:
                    yield flush()
                    docs, starts, parts, size, block = [], [0], [], 0, block + 1
        if docs:
            yield flush()

    return run


def write_store(docs: DataFrame, path: str, file: str, end_id: int = 2, block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every text of ``docs`` (doc_id, text) into a store at ``path``, in ascending doc_id order.

    Documents are dealt by doc_id range (the only shuffle); a block holds whole
    documents and closes at ``block_tokens``.
    """
    spark = docs.sparkSession
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).repartitionByRange(partitions(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(_blocks(file, end_id, block_tokens), BLOCK_SCHEMA).write.parquet(path)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def block_bases(store: DataFrame) -> DataFrame:
    """shard, base: ids of all shards before it. One row a shard reaches the window."""
    sums = store.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("shard", F.coalesce(F.sum("total").over(w), F.lit(0)).alias("base"))


def digests(store: DataFrame) -> DataFrame:
    """Per stored document: doc_id, start, n_tokens, ids_crc32, read back from the levels."""
    inner = Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = store.select("shard", "block", "n_tokens").withColumn("inner_base", F.coalesce(F.sum("n_tokens").over(inner), F.lit(0))).drop("n_tokens")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, block, docs, starts, levels = (batch.column(c)[row].as_py() for c in ("shard", "block", "doc_ids", "doc_starts", "levels"))
                crc = [zlib.crc32(access_range(levels, a, b).astype("<u4").tobytes()) for a, b in zip(starts, starts[1:])]
                n = len(docs)
                cols = [pa.array(docs, pa.int64()), pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), pa.array(starts[:-1], pa.int64()), pa.array(np.diff(starts), pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "shard", "block", "local", "n_tokens", "ids_crc32"])

    read = store.select("shard", "block", "doc_ids", "doc_starts", "levels").mapInArrow(run, "doc_id long, shard int, block int, local long, n_tokens long, ids_crc32 long")
    placed = read.join(before, ["shard", "block"]).join(block_bases(store), "shard")
    return placed.select("doc_id", (F.col("base") + F.col("inner_base") + F.col("local")).cast("long").alias("start"), "n_tokens", "ids_crc32")


def tokens_at(store: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (doc_id, position) plus ``token``: random access by rank steps; positions outside the document give null."""
    index = store.select("shard", "block", F.posexplode("doc_ids").alias("i", "doc_id"), "doc_starts").select("shard", "block", "doc_id", F.element_at("doc_starts", F.col("i") + 1).alias("a"), F.element_at("doc_starts", F.col("i") + 2).alias("b"))
    placed = wanted.select("doc_id", F.col("position").cast("long")).join(index, "doc_id", "left").withColumn("at", F.when((F.col("position") >= 0) & (F.col("position") < F.col("b") - F.col("a")), F.col("a") + F.col("position")))

    def run(asked: pa.Table, blocks: pa.Table) -> pa.Table:
        token = pa.nulls(asked.num_rows, pa.int64())
        if blocks.num_rows and asked.num_rows:
            at = asked.column("at").combine_chunks()
            here = np.array(at.is_valid())
            got = np.zeros(asked.num_rows, np.int64)
            got[here] = access(blocks.column("levels")[0].as_py(), at.drop_null().to_numpy())
            token = pa.array(got, pa.int64(), mask=~here)
        return pa.table({"doc_id": asked.column("doc_id"), "position": asked.column("position"), "token": token})

    return placed.groupBy("shard", "block").cogroup(store.select(F.col("shard").alias("s"), F.col("block").alias("b"), "levels").groupBy("s", "b")).applyInArrow(run, "doc_id long, position long, token long")
