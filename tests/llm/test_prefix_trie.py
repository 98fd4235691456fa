"""The trie against a plain one in dictionaries, contraction on trees of many shapes, running sums in large groups."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from prepcast.llm.prefix_trie import subtree_totals, trie
from prepcast.llm.running import running

SCHEMA = "conv_id long, turn int, role string, text string, id int, parent string, place int"


def brute(rows):
    convs = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            convs[c].append((turn is not None, turn or 0, role, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), text))
    seq = {c: [(x[2], x[4]) for x in sorted(ts)] for c, ts in convs.items()}
    new = {}
    for c in seq:
        h = zlib.crc32(str(c).encode()) % 6
        new[c] = seq.get(c - c % 100, [])[:h] + seq[c][h:]
    member = defaultdict(list)
    for c, ts in new.items():
        for d in range(len(ts) + 1):
            member[tuple(ts[:d])].append(c)
    kids = defaultdict(int)
    for k in member:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, cs in member.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(cs) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, cs in member.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(new[c]) == len(k))))
        out.append((min(cs), len(k), min(member[k[:-1]]) if k else None, len(cs), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    df = spark.createDataFrame([(*r, 1, "p", 2) for r in rows], SCHEMA).repartition(4)
    return sorted((tuple(r) for r in trie(df)["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"].collect()), key=str)


def test_equals_a_plain_trie(spark):
    rng = np.random.default_rng(4)
    rows = []
    for c in [*range(0, 60), *range(100, 130), *range(205, 220), 1000, 123456789]:
        for t in range(int(rng.integers(1, 9))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"turn {int(rng.integers(0, 2))} ü" * int(rng.integers(0, 2))))
    rows += [(c, t, "user", "the same long conversation") for c in range(3000, 3030) for t in range(12)]
    rows += [(7, None, None, None), (7, None, "user", None), (8, 1, "user", "tie"), (8, 1, "user", "tie"), (8, 1, "a", "tie"), (None, 1, "user", "nobody"), (9, 400, "x", "z" * 10_000)]
    rows += [(5001, 0, "user", "one turn")]  # may lose all its turns
    assert found(spark, rows) == brute(rows)


def test_nothing_and_one(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "x")]) == []
    assert found(spark, [(1, None, None, None)]) == brute([(1, None, None, None)])


@pytest.mark.parametrize("shape", ["chain", "random", "brooms"])
def test_subtree_totals(spark, shape):
    n = 90
    rng = np.random.default_rng(1)
    up = {"chain": lambda i: i - 1, "random": lambda i: int(rng.integers(0, i)), "brooms": lambda i: i - 1 if i % 40 < 25 else i - i % 40 + 24 if i % 3 else 0}[shape]
    parent = [None] + [up(i) for i in range(1, n)]
    weight = rng.integers(0, 9, n).tolist()
    want = list(weight)
    for i in range(n - 1, 0, -1):
        want[parent[i]] += want[i]
    got = subtree_totals(spark.createDataFrame(list(zip(range(n), parent, weight)), "id long, parent long, w long"), ["w"])
    assert dict(map(tuple, got.collect())) == dict(enumerate(want))


@pytest.mark.parametrize("xor", [False, True])
def test_running_over_borders(spark, xor):
    rng = np.random.default_rng(3)
    rows = [(int(g), i, int(v)) for i, (g, v) in enumerate(zip(rng.choice([1, 2, 3, 9], 3000, p=[0.9, 0.05, 0.04, 0.01]), rng.integers(-2**62, 2**62, 3000)))]
    got = {r["at"]: r["v"] for r in running(spark.createDataFrame(rows, "g long, at long, v long").repartition(5), "g", ["at"], ["v"], "t", xor).collect()}
    sums = defaultdict(int)
    for g, at, v in rows:
        sums[g] = sums[g] ^ v if xor else (sums[g] + v + 2**63) % 2**64 - 2**63
        assert got[at] == sums[g]


def test_subtree_totals_are_read_by_two_scans(spark):
    rows = [(i, i - 1 if i else None, 1) for i in range(60)]
    got = subtree_totals(spark.createDataFrame(rows, "id long, parent long, w long"), ["w"])
    assert got._jdf.queryExecution().optimizedPlan().toString().count("parquet") <= 2  # one or more a round before
    assert {r["id"]: r["w"] for r in got.collect()} == {i: 60 - i for i in range(60)}
