"""Brute-force checks of the operators over pairs of documents, and of the pipeline."""

import hashlib
import itertools
import re

import numpy as np
import pytest

from prepcast.llm import decontaminate, neardup, substring_dedup
from prepcast.llm.components import components
from prepcast.llm.grouped_suffixes import suffix_array

SCHEMA = "doc_id long, text string, node long, uid long, key string, a long, doc long, th long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "k", 3, 4, 5) for i, t in rows], SCHEMA).repartition(3)


def fold(text):
    return [re.sub("[A-Z]+", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def corpus(seed=0):
    """Copies, near copies in a chain and around a base, shared passages, and edge texts."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(500)]
    draw = lambda n: list(rng.choice(words, n))
    base, passage = draw(120), draw(60)
    rows = [(i, " ".join(draw(rng.integers(3, 150)))) for i in range(60)]
    for i in range(60, 90):  # near copies of one base, at many distances
        w = base[:]
        for k in rng.integers(0, 120, i - 58):
            w[k] = str(rng.choice(words))
        rows.append((i, " ".join(w)))
    chain = draw(100)
    for i in range(90, 110):  # each close to the one before
        chain = chain[2:] + draw(2)
        rows.append((i, " ".join(chain)))
    rows += [(i, " ".join(draw(40) + passage + draw(40))) for i in range(110, 125)]
    rows += [(i, rows[5][1]) for i in (200, 201, 202)] + [(203, rows[5][1].upper())]
    rows += [(300, None), (301, ""), (302, " \n "), (303, "one"), (304, "One"), (305, "z" * 5000), (306, "z" * 5000), (307, "la " * 3000), (400, "x y"), (400, "x y")]
    return rows


def linked(rows, k, percent):
    sets = []
    for _, t in rows:
        w = fold(t)
        sets.append({tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return sorted((d, len(sets[i]), least[find(i)], least[find(i)] == d) for i, (d, _) in enumerate(rows))


@pytest.mark.parametrize("block", [neardup.BLOCK, 4])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, block):
    """With blocks of four the long-list path does the work, and must find the same."""
    rows = corpus()
    real = neardup.links
    monkeypatch.setattr(neardup, "links", lambda signed, k, percent: real(signed, k, percent, block))
    got = sorted(tuple(r) for r in neardup.near_duplicates(frame(spark, rows), k=4, percent=80).collect())
    assert got == linked(rows, 4, 80)


def test_near_duplicates_of_nothing(spark):
    assert neardup.near_duplicates(frame(spark, [])).count() == 0
    got = neardup.near_duplicates(frame(spark, [(None, "a b c d e f"), (7, "a b c d e f"), (None, None)])).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (0, 7), (7, 7)]


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, k) for k in range(101, 130)] + [(200, 201), (201, 200), (300, 300)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(51)}, **{i: 100 for i in range(100, 130)}, 200: 200, 201: 200}


def removed(rows, size=100):
    first, out = {}, []
    for i, t in sorted(rows, key=lambda r: r[0]):
        raw = (t or "").encode()
        hit = np.zeros(len(raw), bool)
        for p in range(len(raw) - size + 1):
            d = first.setdefault(raw[p:p + size], (i, p))
            if d < (i, p) and not (d[0] == i and d[1] == p):
                hit[p:p + size] = True
        runs = int((np.diff(np.concatenate([[0], hit.astype(int)])) == 1).sum())
        out.append((i, len(raw), int(hit.sum()), runs, hashlib.sha256(bytes(np.frombuffer(raw, np.uint8)[~hit])).hexdigest()))
    return sorted(out)


def substrings(seed=3):
    rng = np.random.default_rng(seed)
    draw = lambda n: "".join(rng.choice(list("abcé \n"), n))
    core, long = draw(98), draw(260)
    rows = [(i, draw(rng.integers(0, 400))) for i in range(20)]
    rows += [(20 + i, draw(5) + core[i % 3:] + draw(rng.integers(0, 30))) for i in range(40)]  # shared cores with many edges
    rows += [(60 + i, draw(30) + long[rng.integers(0, 80):rng.integers(150, 260)] + draw(30)) for i in range(20)]
    rows += [(90, "q" * 1000), (91, "ab" * 400), (92, "q" * 150 + "ab" * 80), (93, None), (94, ""), (95, rows[3][1]), (96, "x" * 99), (97, "x" * 100)]
    return rows


@pytest.mark.parametrize("hot", [substring_dedup.HOT, 1])
def test_substring_dedup_equals_brute_force(spark, hot):
    """With hot = 1 every mixed core is finished by grouped windows, and must agree."""
    rows = substrings()
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.dedup(frame(spark, rows), hot).collect())
    assert got == removed(rows)
    if hot == 1:
        assert substring_dedup.dedup(frame(spark, [])).count() == 0


def test_substring_dedup_null_and_repeated_ids(spark):
    t = "the quick brown fox jumps over the lazy dog again and again until it has had quite enough of the dog for one day"
    got = sorted((r.doc_id or -1, r.n_removed) for r in substring_dedup.dedup(frame(spark, [(5, t), (5, t), (None, t), (6, t)])).collect())
    assert got == [(-1, len(t)), (5, 0), (5, 0), (6, len(t))]
    rng = np.random.default_rng(7)
    draw = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared, inner, tail = draw(400), draw(150), draw(160)
    rows = [(i, draw(200) + shared + draw(90)) for i in (5, 5, 5, None, None, 9)]
    rows += [(None, tail), (None, tail + "x"), (None, tail), (3, "A" + inner + "B" + inner), (3, "C" + inner), (None, None), (None, "")]
    frames = frame(spark, rows).select("doc_id", "text").repartition(4)
    ordered = frames.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) th").collect()
    ordered.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.th))
    place = {}
    for r in ordered:
        place.setdefault((r.doc_id, r.text or ""), len(place))  # equal rows are one document
    want = {k[0]: k[1:] for k in removed([(i, t) for (_, t), i in place.items()])}
    got = sorted((r.doc_id or -1, *tuple(r)[1:5]) for r in substring_dedup.dedup(frames).collect())
    assert got == sorted((i or -1, *want[place[i, t or ""]]) for i, t in rows)


def test_suffix_arrays():
    rng = np.random.default_rng(0)
    for _ in range(300):
        x = rng.integers(1, rng.integers(2, 7), rng.integers(0, 60)).tolist()
        x = (x * 3)[:60] + [0]
        assert suffix_array(x) == sorted(range(len(x)), key=lambda i: x[i:])


def test_overlaps_with_the_benchmark(spark):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)]
    draw = lambda n: list(rng.choice(words, n))
    items = [(k, draw(n)) for k, n in enumerate((4, 5, 7, 14, 20, 40, 59))]
    rows, want = [], set()
    for i in range(70):
        rows.append((i, " ".join(draw(rng.integers(0, 200)))))
    for k, w in items:
        for j, step in enumerate((0, 6, 8)):  # exact, and every sixth or eighth word replaced
            if step and len(w) < 14:
                continue
            x = [words[0] if step and n % step == 3 else v for n, v in enumerate(w)]
            rows.append((1000 + 10 * k + j, " ".join(draw(30)) + ". " + ", ".join(x).upper() + "! " + " ".join(draw(30))))
            if len(w) >= 5:
                want.add((1000 + 10 * k + j, k))
        rows.append((2000 + k, " ".join(draw(20) + w[:min(len(w) // 3, 9)] + draw(20))))
    rows += [(3000, None), (3001, ""), (3002, "word " * 20000)]
    bench = spark.createDataFrame([(k, " ".join(w), "x") for k, w in items] + [(90, None, "x"), (91, "", "x"), (5, " ".join(items[5][1]), "y")], "item_id long, text string, uid string")
    docs = frame(spark, rows)
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(docs, bench).collect()} == want
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in rows} - {i for i, _ in want}
    assert decontaminate.overlaps(docs, bench.limit(0)).count() == 0 and decontaminate.overlaps(docs.limit(0), bench).count() == 0


def test_best_segment_equals_brute_force():
    rng = np.random.default_rng(2)
    for _ in range(400):
        same = rng.random(rng.integers(1, 25)) < 0.75
        best = max((j - i for i in range(len(same)) for j in range(i, len(same) + 1) if 5 * same[i:j].sum() >= 4 * (j - i)), default=0)
        begin, end, hits = decontaminate.best_segment(same)
        assert same[begin:end].sum() == hits and end - begin <= best and (hits == 0 or same[begin] and same[end - 1])
        assert best == 0 or hits >= 0.8 * best - 1e-9


def test_masks_reach_every_match_of_a_short_item():
    for n in range(decontaminate.SHORTEST, decontaminate.SHORT):
        need = min(decontaminate.NEED, max(decontaminate.SHORTEST, -(-4 * n // 5)))
        for gone in itertools.chain.from_iterable(itertools.combinations(range(n), m) for m in range(n - need + 1)):
            same = np.ones(n, bool)
            same[list(gone)] = False
            if decontaminate.best_segment(same)[2] >= need:
                assert any(all(same[p + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.masks_of(n) for p in range(n - len(m) + 1)), (n, gone)


def test_overlaps_go_by_row_and_keep_items_without_id(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(200)]
    item, other, clear = " ".join(words[:20]), " ".join(words[40:47]), " ".join(words[100:150])
    swapped = " ".join(words[40:42] + ["x"] + words[43:47])
    rows = [(None, "so " + item), (None, clear), (7, item + " so"), (7, clear), (8, "so " + swapped + " on"), (9, None)]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, __bad string, __th int")
    bench = spark.createDataFrame([(None, item), (3, other), (None, None), (None, "too short")], "item_id long, text string")
    got = sorted((r.doc_id or 0, r.item_id or 0, r.matched_words) for r in decontaminate.overlaps(docs, bench).collect())
    assert got == [(0, 0, 20), (7, 0, 20), (8, 3, 6)]
    kept = decontaminate.clean(docs, bench)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, clear), (7, clear), (9, "")]


def test_copies_go_by_row(spark):
    rng = np.random.default_rng(12)
    draw = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 5000, n))
    one, two, three, four = (draw(60) for _ in range(4))
    rows = [(None, one), (None, one), (None, one + " end"), (5, two), (5, two + " end"), (5, three), (None, three + " end"), (6, four), (6, four), (None, ""), (None, None), (None, " "), (9, "")]
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in rows], "doc_id long, text string, __gone string, __th int").repartition(3)
    kept = neardup.drop_copies(docs)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert kept.columns == docs.columns and len(got) == 9
    assert sum((t or "").startswith(one) for _, t in got) == 1 and sum((t or "").startswith(two) for _, t in got) == 1
    assert sorted(t or "" for i, t in got if not (t or "").strip()) == ["", "", "", " "] and (5, three) in got and got.count((6, four)) == 2
    assert neardup.drop_copies(docs.limit(0)).count() == 0


def test_masks_hit_alignments_with_a_fifth_replaced():
    rng = np.random.default_rng(1)
    hit = 0
    for _ in range(2000):
        same = np.ones(30, bool)
        same[rng.choice(30, 6, replace=False)] = False
        hit += any(all(same[p + j] for j, c in enumerate(m) if c == "1") for m in decontaminate.MASKS for p in range(30 - len(m) + 1))
    assert hit / 2000 > 0.95


def test_pipeline_stages_agree_with_their_operators(spark, tmp_path):
    import corpus_pipeline as P

    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    draw = lambda n: " ".join(rng.choice(words, n))
    item = draw(30)
    rows = [(i, draw(60) + (" vile vileness vilely" if i % 5 == 0 else ""), "en", f"s{i % 3}", 1) for i in range(300)]
    rows += [(400, rows[1][1], "en", "s0", 1), (401, rows[2][1] + " more", "en", "s0", 1), (402, draw(20) + " " + item, "en", "s0", 1), (403, draw(30) + " a.b@example.org", "en", "s1", 1), (404, None, None, None, None), (405, "", "en", "s1", 0)]
    d = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(300)], "doc_id long, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    assert [n for n, _ in P.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    seen = []
    for name, stage in P.STAGES:
        out = stage(spark, docs, d)
        path = f"{d}/{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            seen.append({r.doc_id: r for r in docs.collect()})
    toxic = {i for i in range(300) if i % 5 == 0}
    every = {r[0] for r in rows}
    assert len(toxic & set(seen[0])) <= 3 and every - toxic <= set(seen[0])
    assert set(seen[0]) - set(seen[1]) == {400, 401}
    assert set(seen[1]) - set(seen[2]) == {402}
    assert set(seen[3]) == set(seen[2]) and seen[3][403].text.endswith(" [EMAIL]") and seen[3][403].n_chars == len(seen[3][403].text) and seen[3][404].text is None
    packed = docs.groupBy("doc_id").sum("length").collect()
    assert {r.doc_id for r in packed} == set(seen[3])
    again = P.run(spark, d)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def test_near_duplicates_send_small_batches_to_python(spark, monkeypatch):
    from prepcast.llm import scratch

    key, seen, real = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, neardup.written
    before = spark.conf.get(key)

    def noted(df, name, *more):
        seen[name] = max(seen.get(name, 0), int(spark.conf.get(key)))
        return real(df, name, *more)

    monkeypatch.setattr(neardup, "written", noted)
    assert neardup.near_duplicates(frame(spark, [(1, "a b c d e f"), (2, "a b c d e g")])).count() == 2
    # 10,000 texts, pairs of texts and pairs of blocks before
    assert (seen["neardup-signed"], seen["neardup-links"], seen["neardup-block-links"]) == (neardup.TEXT_ROWS, neardup.PAIR_ROWS, neardup.BLOCK_ROWS)
    assert spark.conf.get(key) == before

    def sizes(batches):
        for batch in batches:
            yield type(batch).from_pydict({"id": [batch.num_rows]})

    with scratch.small_batches(spark, 100):
        most = spark.range(1000, numPartitions=1).mapInArrow(sizes, "id long").toPandas()["id"].max()
    assert most == 100


def test_the_sieve_keeps_texts_out_of_python(spark):
    from pyspark.sql import functions as F

    from prepcast.llm.sieve import sieve

    rows = spark.range(20_000).selectExpr("id * 1000003 - 7 as node", "repeat('x', 20) as text").repartition(3)
    wanted = rows.where("node % 7 = 0").select("node")
    got = sieve(rows.unionByName(spark.range(1).selectExpr("cast(null as long) as node", "'none' as text")), "node", wanted)
    assert "MapInArrow" not in got._jdf.queryExecution().toString() and got.columns == ["node", "text"]
    n = wanted.count()
    assert got.join(wanted, "node").count() == n and n <= got.count() <= n + 100  # a few pass by chance
    assert sieve(rows, "node", rows.where(F.lit(False)).select("node")).count() == 0


def test_intervals_equal_brute_force():
    from prepcast.llm.text import BYTE, prefix_hash, span_hash

    rng, place = np.random.default_rng(4), (1 << 24) - 1
    for sizes in ([0, 130, 99, 100, 0, 400, 1], [40, 59, 1], [99, 1], [70_000], []):  # the second and third stopped the job before
        offs = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        data = rng.integers(97, 99, offs[-1]).astype(np.uint8)
        prefix, want = prefix_hash(BYTE[data]), []
        for i, (a, b) in enumerate(zip(offs, offs[1:])):
            grams = span_hash(prefix, np.arange(a, max(a, b - substring_dedup.GRAM + 1)), np.arange(a + substring_dedup.GRAM, max(a + substring_dedup.GRAM, b + 1)))
            key = [(int(h) & ~place) | int(a + k) for k, h in enumerate(grams)]
            for lo in range(a, b - substring_dedup.WINDOW + 1):
                q = min(key[lo - a:lo - a + substring_dedup.SPAN]) & place
                if want and want[-1][:2] == [i, q]:
                    want[-1][3] = lo
                else:
                    want.append([i, q, lo, lo, int(grams[q - a])])
        got = substring_dedup.intervals(data, offs, prefix)
        assert [list(map(int, x)) for x in zip(*got)] == want


def test_texts_go_to_python_in_small_batches_in_every_written_step(spark, monkeypatch):
    from prepcast.llm import packing, scratch
    from prepcast.llm.tokens import tokenizer_file

    seen, real = {}, scratch.written

    def noted(df, name, *more):
        seen[name] = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
        return real(df, name, *more)

    for module in (packing, decontaminate):
        monkeypatch.setattr(module, "written", noted)
    docs = spark.createDataFrame([(1, "a b c", "s"), (2, None, "s")], "doc_id long, text string, source string")
    assert packing.pack(docs, tokenizer_file()).count() == 2
    assert decontaminate.overlaps(docs, spark.createDataFrame([(1, "x y z u v w")], "item_id long, text string")).count() == 0
    assert seen["packing-ids"] == seen["decontaminate-hits"] == scratch.TEXT_ROWS  # 10,000 before
