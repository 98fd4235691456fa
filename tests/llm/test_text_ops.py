"""Edge cases and brute-force checks of the per-document operators."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from prepcast.llm import compression, context_mixing, direct_codes, packing, pii, quality, toxicity
from prepcast.llm.tokens import Encoder, tokenizer_file

SCHEMA = "doc_id long, text string, source string, n long, node long, base string, h string, queue string, uid long"
LONG = "lorem ipsum dolor " * 9000
TEXTS = [
    (1, "Hello, world. Call +1 (555) 010-9999 or mail a.b@ex-ample.org now."),
    (2, None),
    (3, ""),
    (4, "  \n\t "),
    (5, "Straße ÉCOLE naïve — don't STOP. 'tis 3.14, 10.0.0.256 10.1.2.3"),
    (5, "Straße ÉCOLE naïve — don't STOP. 'tis 3.14, 10.0.0.256 10.1.2.3"),
    (6, LONG),
    (7, "4111 1111 1111 1111 and 4111-1111-1111-1112 and x@y.zz.q_w@e.ff"),
    (8, "a" * 300_000),
    (9, "same line\nsame line\n\nsame line\n <|endoftext|> <|ENDOFTEXT|>"),
    (None, "no id here"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, None if i == 3 else f"s{(i or 0) % 2}", 1, 2, "b", "h", "q", 3) for i, t in TEXTS], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def ids():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_file())
    return lambda t: tok.encode(t or "", add_special_tokens=False).ids + [2]


def test_encoder_equals_library_with_a_tiny_cache(ids):
    enc = Encoder(tokenizer_file(), cache_words=3)
    for _, t in TEXTS[:8] * 2:
        assert np.frombuffer(enc.ids((t or "").encode()), "<u4").tolist() == ids(t)[:-1]


def test_levels_round_trip_and_random_access():
    rng = np.random.default_rng(0)
    for n in (0, 1, 511, 512, 513, 5000):
        x = (2 ** rng.uniform(0, 32, n)).astype(np.uint32)
        levels = direct_codes.encode_levels(x)
        at = rng.permutation(n)
        assert (direct_codes.access(levels, at) == x[at]).all()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert (direct_codes.access_range(levels, a, b) == x[a:b]).all()


def test_store_digests_and_lookup(spark, docs, empty, ids, tmp_path):
    path = str(tmp_path / "store")
    direct_codes.write_store(docs, path, tokenizer_file(), block_tokens=64)
    store = direct_codes.read_store(spark, path)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens, r.ids_crc32) for r in direct_codes.digests(store).collect())
    want, at = [], 0
    for i, t in sorted(TEXTS, key=lambda x: -1 if x[0] is None else x[0]):
        x = ids(t)
        want.append((-1 if i is None else i, at, len(x), zlib.crc32(np.array(x, "<u4").tobytes())))
        at += len(x)
    assert got == sorted(want)
    asked = spark.createDataFrame([(1, 0), (6, 20000), (6, 10**9), (77, 0), (2, 0)], "doc_id long, position long")
    found = {(r.doc_id, r.position): r.token for r in direct_codes.tokens_at(store, asked).collect()}
    assert found == {(1, 0): ids(TEXTS[0][1])[0], (6, 20000): ids(LONG)[20000], (6, 10**9): None, (77, 0): None, (2, 0): 2}
    none = str(tmp_path / "none")
    direct_codes.write_store(empty, none, tokenizer_file())
    assert direct_codes.digests(direct_codes.read_store(spark, none)).count() == 0


@pytest.mark.parametrize("mixture", [None, {"s0": 3.0, "s1": 1.0}])
def test_packing_is_gapless_and_follows_the_mixture(docs, empty, ids, mixture):
    window = 256
    got = packing.pack(docs, tokenizer_file(), window=window, mixture=mixture).collect()
    lengths = {i: len(ids(t)) for i, t in TEXTS}
    pieces = {}
    for r in got:
        pieces.setdefault(r.doc_id, []).append(r)
    for i, t in TEXTS:
        x, copies = ids(t), sum(j == i for j, _ in TEXTS)
        covered = np.zeros(len(x), int)
        for r in pieces[i]:
            assert zlib.crc32(np.array(x[r.start:r.start + r.length], "<u4").tobytes()) == r.ids_crc32 and r.doc_tokens == len(x)
            covered[r.start:r.start + r.length] += 1
        assert (covered == copies).all()
    total = sum(lengths[i] for i, _ in TEXTS)
    filled = np.zeros(-(-total // window) * window, int)
    for r in got:
        at = r.sequence_id * window + r.offset
        assert r.offset + r.length <= window
        filled[at:at + r.length] += 1
    assert (filled[:total] == 1).all() and not filled[total:].any()
    if mixture:  # while both last, each window holds three ids of s0 for one of s1
        share = {}
        for r in got:
            share.setdefault(r.sequence_id, {}).setdefault(r.source, []).append(r.length)
        assert abs(sum(share[0]["s0"]) - 192) <= 8
    assert packing.pack(empty, tokenizer_file()).count() == 0


def test_packing_plan_closed_form_equals_running_rounds():
    totals, window = [700, 13, 2900, 1], 64
    plan = packing.Plan(totals, None, window)
    size = sum(totals)
    rounds = -(-size // window)
    stream, sent = [], [0] * 4
    for r in range(1, rounds + 1):
        for q, n in enumerate(totals):
            now = n * r // rounds
            stream += [(q, t) for t in range(sent[q], now)]
            sent[q] = now
    place = {x: i for i, x in enumerate(stream)}
    for q, n in enumerate(totals):
        for start, length, at in zip(*plan.pieces(q, 0, n)):
            assert [place[q, start + k] for k in range(length)] == list(range(at, at + length)) and at // window == (at + length - 1) // window


PATTERNS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m, d: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m, d: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m, d: 12 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d))) % 10 == 0),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m, d: 9 <= len(d) <= 15),
]


def base_spans(text):
    out = []
    for k, (name, pattern, ok) in enumerate(PATTERNS):
        out += [(m.start(), k, f"{name}:{m.start()}:{m.end()}") for m in re.finditer(pattern, text or "") if ok(m.group(), re.sub("[^0-9]", "", m.group()))]
    return [s for _, _, s in sorted(out)]


def test_pii_base_spans(spark, docs, empty):
    rng = np.random.default_rng(4)
    alphabet = list("0123456789..@@+- ()ab_%é\n") + ["1.2.3.4", "4111111111111111", "a@b.cc"]
    rows = [(i, "".join(rng.choice(alphabet, rng.integers(0, 60)))) for i in range(300)] + [(1000, "1" * 60000 + " " + "9." * 30000 + "x@" * 2000)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    for i, t in rows:
        spans = base_spans(t)
        assert got[i].base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest(), t
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s.startswith(k) for s in spans) for k, *_ in PATTERNS]
    assert pii.find(docs).count() == len(TEXTS) and pii.find(empty).count() == 0


def test_pii_terms_that_give_an_entity_away(spark):
    rows = [(i, f"note {i} from zorblat, write to ann@corp.example today please {w}") for i, w in enumerate("red blue green grey".split())]
    rows += [(100 + i, f"note {i} today please from nobody write to us") for i in range(60)]
    frame = spark.createDataFrame([(i, t, 7, "kept") for i, t in rows], "doc_id long, text string, n_chars int, base string")
    spans = {r.doc_id: r.spans for r in pii.find(frame).collect()}
    a = rows[0][1].index("zorblat")
    assert f"removed:{a}:{a + 7}" in spans[0].split(",") and "email" in spans[0] and spans[100] == ""
    assert not any(s.startswith(("general", "removed")) and rows[0][1][int(s.split(":")[1]):int(s.split(":")[2])] == "today" for s in spans[0].split(","))
    clean = {r.doc_id: r for r in pii.sanitise(frame).collect()}
    assert clean[0].text == "note 0 from , write to [EMAIL] today please red" and clean[0].n_chars == len(clean[0].text) and clean[0].base == "kept"
    assert clean[100].text == rows[4][1]


def test_compression_counts_and_bands(docs, empty):
    rows = {}
    for r in compression.assess(docs).collect():
        rows[r.doc_id] = r
    for i, t in TEXTS:
        t, r = t or "", rows[i]
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        seen, dup = set(), 0
        for line in t.split("\n"):
            if re.search(r"[^\x20\x09-\x0D]", line):
                dup += line in seen
                seen.add(line)
        grams = [tuple(w[k:k + 8]) for k in range(len(w) - 7)]
        count = {}
        for g in grams:
            count[g] = count.get(g, 0) + 1
        cover = {k + j for k, g in enumerate(grams) if count[g] > 1 for j in range(8)}
        failed = len(w) < 20 or 100 * len(cover) > 30 * len(w)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(cover), failed)
        assert not (r.kept and failed)
    assert rows[6].verdict == rows[8].verdict == "repetitive" and rows[3].ratio is None
    assert compression.assess(empty).count() == 0


def test_compression_rejects_incompressible_and_bad_parts(spark):
    rng = np.random.default_rng(1)
    noise = "".join(rng.choice([chr(c) for c in range(33, 127)], 20000))
    prose = " ".join("".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(6000))
    rows = [(1, " ".join(noise[k:k + 7] for k in range(0, 20000, 7))), (2, prose), (3, prose + " " + "spam ham eggs " * 1500)]
    got = {r.doc_id: r.verdict for r in compression.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "incompressible", 2: "ok", 3: "bad chunks"}


def _labelled(spark, seed=0):
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdeilmnorst"), rng.integers(2, 8))) for _ in range(400)]
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        w = list(rng.choice(words, 60))
        if bad:
            for k in rng.integers(0, 60, 3):
                w[k] = "vile" + str(rng.choice(["ness", "ly", "st"]))
        rows.append((i, " ".join(w), " ".join([*w[:5]] * 12) if bad else " ".join(w), int(bad)))
    return rows


def test_toxicity_held_out(spark, docs, empty):
    rows = _labelled(spark)
    frame = spark.createDataFrame([(i, t) for i, t, _, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in rows] + [(1, 1), (2, None), (None, 1), (9999, 0)], "doc_id long, toxic int")
    model = toxicity.train(frame, labels)
    got = {r.doc_id: r for r in toxicity.score(frame, model).collect()}
    for i, _, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
    held = [(got[i].predicted, y) for i, _, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.95
    edge = toxicity.score(docs, model).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r.score <= 1 for r in edge)
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and toxicity.score(empty, model).count() == 0 and toxicity.keep_clean(empty, model).count() == 0
    none = toxicity.train(empty, labels.limit(0))
    assert {r.predicted for r in toxicity.score(docs, none).collect()} == {0}


def test_quality_held_out(spark, docs, empty):
    rows = _labelled(spark, 1)
    frame = spark.createDataFrame([(i, t) for i, _, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1 - y) for i, _, _, y in rows], "doc_id long, quality int")
    model = quality.train(frame, labels)
    got = {r.doc_id: r for r in quality.score(frame, model).collect()}
    held = [(got[i].predicted, 1 - y) for i, _, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([p == y for p, y in held]) > 0.95
    edge = quality.score(docs, model).collect()
    assert len(edge) == len(TEXTS) and all(0 <= r.score <= 1 for r in edge) and quality.score(empty, model).count() == 0
    none = quality.train(empty, labels.limit(0))
    assert {r.score for r in quality.score(docs, none).collect()} == {0.5}


def test_quality_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.uniform(-1, 1, (4000, len(quality.FEATURES)))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    model = quality.fit(x[:3000], y[:3000])
    assert np.mean((model.score(x[3000:]) > 0.5) == (y[3000:] > 0.5)) > 0.9


def test_mixing_windows_and_probabilities():
    text = b"Ab cdefghij"
    key, first = context_mixing.windows(np.frombuffer(text, np.uint8), np.array([0, 0, len(text)]))
    assert first.tolist() == [0, 1, 1 + len(text) + 1]
    unpack = lambda k: bytes((int(k) >> 8 * j) & 255 for j in range(7, -1, -1))
    assert unpack(key[0]) == b"\0" * 8 and unpack(key[1]) == b"\0" * 7 + b"a" and unpack(key[4]) == b"\0\0\0\0ab c"
    assert unpack(key[8]) == b"\0\0 cdefg" and unpack(key[-1]) == b"defghij\0"
    rng = np.random.default_rng(0)
    weights = rng.normal(0, 0.3, (context_mixing.GATES, len(context_mixing.ORDERS) + 1))
    model = context_mixing.Model(rng.integers(0, 65536, len(context_mixing.ORDERS) << context_mixing.SLOT_BITS).astype(np.uint16), weights)
    every = (key[5] & ~np.uint64(255)) | np.arange(256, dtype=np.uint64)
    assert abs((10 ** model.log10(every)).sum() - 1) < 1e-6  # a distribution over the next symbol


def test_mixing_scores(spark, docs, empty):
    import math

    got = context_mixing.assess(docs).collect()
    assert len(got) == len(TEXTS) and context_mixing.assess(empty).count() == 0
    fold = lambda t: [re.sub("[A-Z]+", lambda m: m.group().lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")] + [None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    count = {}
    for i, t in TEXTS:
        if not held(i):
            for w in fold(t):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()), len(count)
    want = sorted((-1 if i is None else i, held(i), len(fold(t)), sum(w in count for w in fold(t)), n, round(sum(math.log10((count.get(w, 0) + 0.1) / (n + 0.1 * (v + 1))) for w in fold(t)), 4)) for i, t in TEXTS)
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got) == want
    score = {r.doc_id: r.score for r in got}
    assert all(s < 0 for s in score.values()) and -score[8] / 300_000 / math.log10(2) < 0.5  # bits a byte of a run


def test_toxicity_slots_are_found_without_sorting_all_ngrams():
    import time

    from prepcast.llm.text import text_buffer

    rng = np.random.default_rng(5)
    words = ["".join(chr(c) for c in rng.integers(97, 123, n)) for n in rng.integers(1, 9, 20_000)]
    texts = [" ".join(rng.choice(words, n)) for n in (150_000, 900, 0, 300, 5, 500, 20_000)] + ["abc", "", "é" * 9, "AB\tcd" * 3]
    data, offs = text_buffer(pa.array([*texts, None], pa.string()))
    start = time.process_time()
    slots, first = toxicity.features(data, offs)
    spent = time.process_time() - start
    assert spent < 1.2e-6 * len(data)  # sorting them took 3 microseconds a byte
    for i, text in enumerate([*texts[1:], ""], 1):  # the first is longer than a part
        folded = np.array([int(toxicity._FOLD[ord(c)]) if ord(c) < 128 else ord(c) for c in text], np.uint64)
        want = set()
        for k in toxicity.SIZES:
            for a in range(len(folded) - k + 1):
                h = 0
                for j, c in enumerate(folded[a:a + k]):
                    h = (h * int(toxicity._ODD[0]) + int(c)) % 2**64 if j else int(c)
                want.add(h * int(toxicity._ODD[k]) % 2**64)
        want = np.unique(toxicity.mix(np.array(sorted(want), np.uint64)) >> np.uint64(64 - toxicity.SLOT_BITS))
        assert slots[first[i]:first[i + 1]].tolist() == want.tolist()
    part = toxicity.PART
    whole = toxicity.features(*text_buffer(pa.array([texts[0]])))[0]
    assert len(texts[0]) > part and first[1] == len(whole) and (slots[:first[1]] == whole).all()
    toxicity.PART = 10_007
    try:
        cut = toxicity.features(data, offs)
    finally:
        toxicity.PART = part
    assert (cut[0] == slots).all() and (cut[1] == first).all()


def test_encoder_sends_words_of_latin_letters_straight_to_the_model():
    from array import array

    enc = Encoder(tokenizer_file(), cache_words=500)
    assert enc.model is not None
    sent, through = [], enc._encode
    enc._encode = lambda words: sent.extend(words) or through(words)
    rng = np.random.default_rng(3)
    stems = ["".join(rng.choice([*"abcdefghijklmnopqrstuvwxyzßäöüéèçñÉÜÀÞ"], n)) for n in rng.integers(1, 12, 3000)]
    words = [w + m for w, m in zip(stems, rng.choice(["", "", ".", ",", "!!", "&&&", "?!"], len(stems)))]
    odd = ["don't", "x'", "×", "a×b", "÷", "éte", "İx", "ΑΣ", "a<|", "<|endoftext|>", "x.y,", "3.14,", "a1!!", "ﬁx.", "é__", "é́,", "ñ̃", "…", "a…", "!!", "."]
    for at in range(0, len(words), 100):
        text = " ".join([*words[at:at + 100], *odd, *words[at:at + 5]])
        assert enc.ids(text.encode()) == array("I", enc.tok.encode(text, add_special_tokens=False).ids).tobytes()
    assert len([w for w in sent if w.decode() in set(words) | set(stems)]) < 100  # all 3000 before
    plain, enc.model = enc.ids(text.encode()), None  # another tokenizer's steps: all words go through them
    enc.new, enc.old = {}, {}
    assert enc.ids(text.encode()) == plain


def test_context_mixing_deletes_its_working_tables(spark, docs):
    import os

    from prepcast.llm.scratch import shared_dir

    folder = shared_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    assert context_mixing.assess(docs).count() == len(TEXTS)
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before if not name.endswith(".crc")}
    assert left == {"mixing-base", "mixing-scores"}  # slices, counts, grams, answers and texts stayed before


def test_written_free_leaves_no_shuffle_files(spark):
    from prepcast.llm.scratch import written

    files = lambda: {f for f in spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in f}
    before = files()
    written(spark.range(1000).groupBy("id").count(), "freed", free=True)
    assert not files() - before  # the last job's stayed until a later table was written


def test_mixing_slices_in_parts_ask_for_each_window_once():
    texts = [b"the cat", b"", b"sat on the mat " * 4, b"the cat sat", b""]
    sizes, data = pa.scalar([len(t) for t in texts], pa.list_(pa.int64())), pa.scalar(context_mixing.packed(np.frombuffer(b"".join(texts), np.uint8)), pa.binary())
    whole, = context_mixing._parts(sizes, data, 10**6)
    parts = context_mixing._parts(sizes, data, 12)
    assert [p[2] for p in parts] == [slice(0, 2), slice(2, 3), slice(3, 5)]
    turn, first = context_mixing._windows_of(whole)
    got = [context_mixing._windows_of(p) for p in parts]
    assert np.array_equal(np.concatenate([t for t, _ in got]), turn) and np.array_equal(np.concatenate([np.diff(f) for _, f in got]), np.diff(first))
    keep = np.array([True, False, True, False, True])
    for part, kept in ((whole, None), (parts[0], keep), (parts[2], keep)):
        t, f = context_mixing._windows_of(part)
        kinds, n = np.unique(t if kept is None else t[np.repeat(kept[part[2]], np.diff(f))], return_counts=True)
        assert all(np.array_equal(a, b) for a, b in zip((kinds, n), context_mixing._distinct(part, kept)))


def test_mixing_handles_a_large_slice_part_by_part(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(1, 9, 3000)]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (40_000, 0, 90_000, 7, 60_000, 120_000, 30_000)]
    sizes, flat = [len(t) for t in texts], np.frombuffer(b"".join(texts), np.uint8)
    part = pa.table({"slice": [3], "sizes": pa.array([sizes]), "held": pa.array([[False] * 7]), "data": pa.array([context_mixing.packed(flat)], pa.binary())})

    class Table:
        def mapInArrow(self, run, schema):
            return run

    monkeypatch.setattr(context_mixing, "ASK_BYTES", 100_000)
    run = context_mixing._sent(Table(), 5, training=False)
    tracemalloc.start()
    asked = pa.Table.from_batches(run(iter(part.to_batches())))
    most = tracemalloc.get_traced_memory()[1]
    turn, first = context_mixing._windows_of((flat, np.concatenate([[0], np.cumsum(sizes)]), slice(0, 7)))
    kinds = np.unique(turn)
    order, buckets, border = context_mixing.dealt(kinds, 5)
    assert asked.column("bucket").to_pylist() == buckets.tolist()
    assert all(np.array_equal(context_mixing.unpacked(x, np.uint64), kinds[order[a:b]]) for x, a, b in zip(asked.column("grams"), border, border[1:]))
    value = rng.normal(size=len(kinds)).astype(np.float32)
    answers = pa.table({"bucket": buckets, "values": pa.array([context_mixing.packed(value[order[a:b]]) for a, b in zip(border, border[1:])], pa.binary())}).take([4, 0, 3, 1, 2])
    tracemalloc.reset_peak()
    before = tracemalloc.get_traced_memory()[0]
    got = context_mixing._added(part.column("sizes")[0], part.column("data")[0], 5, answers)
    more = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert np.array_equal(got, np.add.reduceat(value[np.searchsorted(kinds, turn)].astype(float), first[:-1]))
    assert max(most, more) < 40 * len(flat), (most / len(flat), more / len(flat))


def test_mixing_makes_windows_block_by_block(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(8)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(1, 9, 3000)]
    texts = [" ".join(rng.choice(words, n)).encode() for n in (9000, 0, 30_000, 7, 30_000, 1, 30_000, 50_000, 50_000)]
    sizes, flat = [len(t) for t in texts], np.frombuffer(b"".join(texts), np.uint8)
    offs, held = np.concatenate([[0], np.cumsum(sizes)]), np.array([False, True, False, True, True, False, False, False, False])
    key, first = context_mixing.windows(flat, offs, context_mixing.REACH)
    turn = context_mixing.turned(key)
    for keep in (None, ~held, held & False):
        want = turn if keep is None else turn[np.repeat(keep, np.diff(first))]
        got = context_mixing._distinct((flat, offs, slice(0, 9)), keep)
        assert all(np.array_equal(a, b) for a, b in zip(got, np.unique(want, return_counts=True)))
    by_bucket = (context_mixing.mix(turn >> np.uint64(40)) % np.uint64(300)).astype(int)
    order, kinds, border = context_mixing.dealt(turn, 300)
    assert np.array_equal(order, np.argsort(by_bucket, kind="stable")) and np.array_equal(by_bucket[order], np.repeat(kinds, np.diff(border)))
    part = pa.table({"slice": [3], "sizes": pa.array([sizes]), "held": pa.array([held.tolist()]), "data": pa.array([context_mixing.packed(flat)], pa.binary())})

    class Table:
        def mapInArrow(self, run, schema):
            return run

    run = context_mixing._sent(Table(), 5, training=True)
    tracemalloc.start()
    sent = pa.Table.from_batches(run(iter(part.to_batches())))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(int(context_mixing.unpacked(n, np.int64).sum()) for n in sent.column("n")) == np.diff(first)[~held].sum()
    assert most < 28 * len(flat), most / len(flat)  # 35 before


def test_workers_give_back_what_they_freed():
    from prepcast.llm.text import slices

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    arrays = [np.ones(12_000) for _ in range(2000)]  # 96 kB each, in the C library's heap
    kept = arrays[::40]
    del arrays
    before = held()
    assert [b.num_rows for b in slices(iter([pa.record_batch({"text": ["a", "b"]})]), "text", 1)] == [1, 1]
    assert before - held() > 100e6 and len(kept) == 50  # nothing before


def test_mixing_buckets_hold_what_is_asked_and_known(monkeypatch):
    rng, pack = np.random.default_rng(7), lambda lists: pa.chunked_array([pa.array([context_mixing.packed(x) for x in lists], pa.binary())])
    monkeypatch.setattr(context_mixing, "CHUNK_GRAMS", 50)
    for known in (np.unique(rng.integers(0, 900, 300).astype(np.uint64)), None):
        asked = [np.unique(rng.integers(0, 1200, n).astype(np.uint64)) for n in (200, 1, 60, 400)]
        count = dict(zip(known.tolist(), range(1, 999))) if known is not None else {}
        table = pa.table({"grams": pack([known]), "n": pack([np.arange(1, len(known) + 1)])}) if count else pa.table({"grams": pack([]), "n": pack([])})
        turn, n = context_mixing._bucket(pack(asked), table)
        want = sorted({*count, *np.concatenate(asked).tolist()})
        assert turn.tolist() == want and n.tolist() == [count.get(x, 0) for x in want] and turn.dtype == np.uint64 and n.dtype == np.int64
        assert not len(context_mixing._bucket(pack([]), table)[0])
