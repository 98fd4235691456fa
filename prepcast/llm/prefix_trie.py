"""Prefix trie of conversations, with subtree totals by parallel tree contraction.

A node is a distinct sequence of first turns. Turns are reduced to a digest where they
are read, so no text is shuffled. The identity of a node is the exclusive or, 128 bits wide, of
a hash of (place, digest) over its turns, which a running pass gives for conversations of any
length; a node's parent is the same without its last turn.

Contraction. Every node starts with its own weights. A round first rakes: nodes without
children are final, and add their totals to their parents. Then it compresses: of the nodes
with one child a part, no two of them next to each other (by coins), is taken out, its
parent taking over its child and its weights. A round removes a fixed share of what is left, whatever the
shape, so rounds grow with the logarithm of the number of nodes, not with depth. Afterwards the compressed
nodes are put back, latest round first: the total of each is its weights at that time
plus its child's total. Every join is on node ids that are unique on both sides, and sums
are by parent with partial sums first, so a node with a third of all nodes as
children is no burden.

Defined cases: rows with a null conv_id take no part; turns are in order of ``turn`` (null first), then role,
then the digest of the text, so equal rows are interchangeable and each counts as a turn; a null role or text
is empty; a conversation without turns is a member of the root only; an empty table gives no
rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepcast.llm.running import running
from prepcast.llm.scratch import partitions, scan, stored, written

TOTALS = ["n_leaves", "saved_tokens"]
HEAVY = 1000  # a key with more than this share of the rows is one of fewer than this many


def turns_in_order(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, chars) of every turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    base = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("digest"),
        F.length(text).cast("long").alias("chars"), F.lit(1).cast("long").alias("place"))
    return running(base, "conv_id", ["turn", "role", "digest"], ["place"], "trie-turns").select("conv_id", "place", "digest", "chars")


def by_weight(left: DataFrame, key: str, right: DataFrame, weight: str, rows: int) -> DataFrame:
    """``left`` inner join ``right`` on ``key`` (unique in ``right``; ``weight``: how many rows of ``left`` have it).

    Keys with more than rows / HEAVY rows are fewer than HEAVY: these are sent to every
    task. The others are joined by shuffle, where none of them is large.
    """
    heavy = F.col(weight) > rows / HEAVY
    few = F.broadcast(right.where(heavy).drop(weight))
    rest = left.join(F.broadcast(right.where(heavy).select(key)), key, "left_anti")
    return left.join(few, key).unionByName(rest.join(right.where(~heavy).drop(weight), key))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conversations: conv_id, length) and (their turns: conv_id, place, digest, chars) after sharing first turns.

    Conversation c gets the first h turns of conversation c - c % 100, h = crc32(c as text) % 6, then its own after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.max("place").alias("n")).withColumn("h", F.crc32(F.col("conv_id").cast("string")) % 6).withColumn("base", F.expr("conv_id - conv_id % 100"))
    bases = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    convs = written(own.join(bases, "base", "left").withColumn("head", F.least("h", F.coalesce("base_n", F.lit(0)))), "trie-convs")
    lengths = convs.select("conv_id", (F.col("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    rows = convs.agg(F.sum("n")).first()[0] or 0
    tail = by_weight(turns, "conv_id", convs.select("conv_id", "h", "head", "n"), "n", rows).where("place > h").selectExpr("conv_id", "place - h + head as place", "digest", "chars")
    firsts = turns.where((F.col("place") <= 5) & (F.col("conv_id") % 100 == 0)).withColumnRenamed("conv_id", "base")
    head = convs.where("head > 0").select("conv_id", "base", "head").join(firsts, "base").where("place <= head").select("conv_id", "place", "digest", "chars")
    return lengths, tail.unionByName(head)


def trie_nodes(lengths: DataFrame, turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, parent, conv_id, depth, n_convs, chars) and (ends: id, conv_id); ids are structs of two longs."""
    hashed = turns.withColumn("a", F.xxhash64("digest", "place")).withColumn("b", F.xxhash64(F.lit(1), "digest", "place"))
    hashed = hashed.withColumns({"own_a": F.col("a"), "own_b": F.col("b")}).drop("digest")
    paths = written(running(hashed, "conv_id", ["place"], ["a", "b"], "trie-sums", xor=True), "trie-paths")
    with_parent = paths.withColumns({"pa": F.col("a").bitwiseXOR(F.col("own_a")), "pb": F.col("b").bitwiseXOR(F.col("own_b"))})
    nodes = with_parent.groupBy("a", "b").agg(F.min("conv_id").alias("conv_id"), F.min("place").alias("depth"), F.count(F.lit(1)).alias("n_convs"), F.min("chars").alias("chars"), F.min("pa").alias("pa"), F.min("pb").alias("pb"))
    ident = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    below = nodes.select(ident("a", "b").alias("id"), ident("pa", "pb").alias("parent"), "conv_id", "depth", "n_convs", "chars")
    zero = F.lit(0).cast("long")
    root = F.struct(zero.alias("a"), zero.alias("b"))
    top = lengths.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0")
    top = top.select(root.alias("id"), F.lit(None).cast("struct<a:bigint,b:bigint>").alias("parent"), "conv_id", zero.alias("depth"), "n_convs", zero.alias("chars"))
    last = by_weight(paths.select("conv_id", "place", "a", "b"), "conv_id", lengths.select("conv_id", "length", F.col("length").alias("w")), "w", lengths.agg(F.sum("length")).first()[0] or 0)
    ends = last.where("place = length").select(ident("a", "b").alias("id"), "conv_id").unionByName(lengths.where("length = 0").select(root.alias("id"), "conv_id"))
    return below.unionByName(top), ends


def children(active: DataFrame) -> DataFrame:
    """(id, kids, child): how many nodes hang below, and one of them. Partial sums first, so any number may."""
    return active.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(F.count(F.lit(1)).alias("kids"), F.min("id").alias("child"))


def subtree_totals(nodes: DataFrame, weights: list[str]) -> DataFrame:
    """(id, *weights) summed over every node's subtree. ``nodes``: id, parent (null at roots), *weights (long)."""
    left = nodes.select("id", "parent", *weights).join(children(nodes).select("id", "kids"), "id", "left")
    states = [stored(left, "trie-round")]  # by round: what is left when it begins; without children are those whose totals are known
    spliced: list[DataFrame] = []
    while True:
        now = scan(left, states[-1])
        if not now.where("kids is not null").take(1):
            break
        # rake: one sum by parent gives what its childless nodes add, and the children that stay
        leaf = F.col("kids").isNull()
        given = now.where("parent is not null").groupBy(F.col("parent").alias("id")).agg(
            F.count(F.when(~leaf, 1)).alias("stay"), F.min(F.when(~leaf, F.col("id"))).alias("child"), *[F.sum(F.when(leaf, F.col(w))).alias(f"add_{w}") for w in weights])
        inner = now.where(~leaf).drop("kids").join(given, "id", "left")
        raked = written(inner.select("id", "parent", *added(weights), F.when(F.col("stay") > 0, F.col("stay")).alias("kids"), "child"), "trie-raked")
        # compress
        coin = F.xxhash64("id", F.lit(len(spliced))) % 2 == 0
        heads = raked.where((F.col("kids") == 1) & F.col("parent").isNotNull() & coin).drop("kids")
        out = written(heads.join(heads.select(F.col("child").alias("id")), "id", "left_anti"), "trie-spliced")
        spliced.append(out)
        # one change a node at most for each of: it is out, its parent is, its children are
        change = F.explode(F.array(
            F.struct(F.col("id"), F.lit(True).alias("out"), F.lit(None).cast(out.schema["id"].dataType).alias("up"), *[F.lit(None).cast("long").alias(f"add_{w}") for w in weights]),
            F.struct(F.col("child").alias("id"), F.lit(None).cast("boolean").alias("out"), F.col("parent").alias("up"), *[F.lit(None).cast("long").alias(f"add_{w}") for w in weights]),
            F.struct(F.col("parent").alias("id"), F.lit(None).cast("boolean").alias("out"), F.lit(None).cast(out.schema["id"].dataType).alias("up"), *[F.col(w).alias(f"add_{w}") for w in weights])))
        changes = out.select(change.alias("x")).select("x.*").groupBy("id").agg(F.max("out").alias("out"), F.max("up").alias("up"), *[F.sum(f"add_{w}").alias(f"add_{w}") for w in weights])
        rest = raked.drop("child").join(changes, "id", "left").where("out is null")
        states.append(stored(rest.select("id", F.coalesce("up", "parent").alias("parent"), *added(weights), "kids"), "trie-round"))
    total = left.select("id", *weights)
    back: list[str] = []

    def known(since: int) -> DataFrame:
        raked = scan(left, *states[since:]).where("kids is null").select("id", *weights)
        return raked.unionByName(scan(total, *back)) if back else raked

    for r in range(len(spliced) - 1, -1, -1):  # every child was left after its round, so its total is among the known
        below = known(r + 1).select(F.col("id").alias("child"), *[F.col(w).alias(f"add_{w}") for w in weights])
        back.append(stored(spliced[r].join(below, "child").select("id", *added(weights)), "trie-back"))
    return known(0)


def added(weights: list[str]) -> list[Column]:
    """Each weight with what ``add_<weight>`` adds to it."""
    return [(F.col(w) + F.coalesce(f"add_{w}", F.lit(0))).alias(w) for w in weights]


def end_digests(ends: DataFrame) -> DataFrame:
    """(id, ends_sha256): SHA-256 of each node's conv_ids in ascending order, joined by commas.

    A digest runs through its ids one after the other. They are dealt by range, so the ids of a
    node are joined to long texts in many tasks; one task then streams a node's texts
    through its digest, 64 Ki ids a row, and holds one of them at a time.
    """
    spark, chunk = ends.sparkSession, 1 << 16
    keyed = ends.select(F.col("id.a").alias("a"), F.col("id.b").alias("b"), "conv_id")
    dealt = keyed.repartitionByRange(partitions(spark), "a", "b", "conv_id").sortWithinPartitions("a", "b", "conv_id")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, out = None, [], []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("a", "b", "conv_id"))):
                if row[:2] != key or len(ids) == chunk:
                    if ids:
                        out.append((*key, ids[0], ",".join(map(str, ids))))
                    key, ids = row[:2], []
                ids.append(row[2])
            if len(out) > 1000:
                yield texts(out)
                out = []
        if ids:
            out.append((*key, ids[0], ",".join(map(str, ids))))
        yield texts(out)

    def texts(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["a", "b", "first", "ids"])

    parts = dealt.mapInArrow(join, "a long, b long, first long, ids string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, out = None, None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                for a, b, ids in zip(*(part.column(c).to_pylist() for c in ("a", "b", "ids"))):
                    if (a, b) != key:
                        if key is not None:
                            out.append((*key, state.hexdigest()))
                        key, state = (a, b), hashlib.sha256(ids.encode())
                    else:
                        state.update(b"," + ids.encode())
            if len(out) > 1000:
                yield digests(out)
                out = []
        if key is not None:
            out.append((*key, state.hexdigest()))
        yield digests(out)

    def digests(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=["a", "b", "ends_sha256"])

    found = parts.repartition(partitions(spark), "a", "b").sortWithinPartitions("a", "b", "first").mapInArrow(digest, "a long, b long, ends_sha256 string")
    return found.select(F.struct("a", "b").alias("id"), "ends_sha256")


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the trie of rebuilt conversations."""
    lengths, turns = rebuilt(turns_in_order(conversations))
    nodes, ends = trie_nodes(lengths, turns)
    nodes = written(nodes, "trie-nodes")
    kids = children(nodes).select("id", F.col("kids").alias("n_children"))
    nodes = written(nodes.join(kids, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "trie-nodes")
    weighed = nodes.select("id", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    totals = subtree_totals(weighed, TOTALS)
    up = nodes.where("n_children > 0").select(F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children").withColumnRenamed("n_children", "w")
    below = nodes.where("parent is not null")
    named = by_weight(below, "parent", up, "w", below.count()).unionByName(nodes.where("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long")))
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    full = named.join(totals, "id").join(end_digests(ends), "id", "left")
    return full.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *TOTALS, F.coalesce("ends_sha256", nothing).alias("ends_sha256"))
