"""Cases of the second review: operators that did less than their whole job."""

import base64
import math
import re
import zlib

import numpy as np

from prepcast.llm import compression, context_mixing, pii, toxicity


def test_mixing_counts_are_exact_and_cross_words(spark):
    rng = np.random.default_rng(8)
    texts = ["".join(rng.choice(list("ab cé"), rng.integers(0, 40))) for _ in range(60)]
    raw = [t.encode() for t in texts]
    key, first = context_mixing.windows(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), context_mixing.REACH)
    turn, n = context_mixing.summed(context_mixing.turned(key), np.ones(len(key), np.int64))
    seen = {}
    for t in raw:
        line = b"\0" * 7 + t + b"\0"
        for i in range(7, len(line)):
            for order in context_mixing.ORDERS:
                for k in range(9):
                    cell = order, line[i - order:i], line[i] >> (8 - k), k
                    seen[cell] = seen.get(cell, 0) + 1
    short = {o: context_mixing.summed(context_mixing.context(turn, o), n) for o in (1, 2)}
    model = context_mixing.Exact([], np.zeros((context_mixing.GATES, 7)))
    model.learn(turn, n, short)
    found = model.find(turn)
    for which, order in enumerate(context_mixing.ORDERS):
        for bit in range(8):
            n0, n1 = model.counts(found, which, bit)
            for i in range(0, len(turn), 7):
                w = int(turn[i])
                ctx = bytes((w >> 56 - 8 * j) & 255 for j in range(order))[::-1]
                known = (w & 255) >> (bit + 1)
                assert (n0[i], n1[i]) == tuple(seen.get((order, ctx, known * 2 + one, 8 - bit), 0) for one in (0, 1))
    rows = [(i, "".join({"m": "mx o p ", "n": "nx o q "}[c] for c in rng.choice(list("mn"), 40))) for i in range(400)]
    got = [r.score for r in context_mixing.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.held_out]
    assert len(got) == sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(400))
    assert -np.mean(got) / math.log10(2) / 40 < 1.5  # the first letter is one bit; the last, after four more bytes, is settled by it


def test_compression_judges_the_bytes_after_the_last_full_chunk(spark):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("etaoinshr"), rng.integers(2, 9))) for _ in range(400)]
    prose = " ".join(rng.choice(words, 4000))
    noise = base64.b64encode(rng.bytes(9000)).decode()
    rows = [(1, prose[:4500] + noise[:3600]), (2, prose[:8100]), (3, prose[:8200] + noise[:3900]), (4, prose[:4090] + noise[:6]), (5, prose[:4200])]
    got = {r.doc_id: r for r in compression.assess(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {i: r.verdict for i, r in got.items()} == {1: "bad chunks", 2: "ok", 3: "bad chunks", 4: "ok", 5: "ok"}
    assert got[1].bad_chunk_share == (8100 - 4096) / 8100 and got[2].bad_chunk_share == got[5].bad_chunk_share == 0 and got[4].bad_chunk_share is None


def _marked(row, text):
    return sorted(text[int(a):int(b)].lower() for k, a, b in (s.split(":") for s in row.spans.split(",") if s) if k in ("general", "removed"))


def test_pii_one_text_tells_nothing_and_several_do(spark):
    fill = " the plain words of every note go on and on" * 4
    rows = [(i, f"Quibbix met us on day {i}.{fill} Write to ann@corp.example.{fill} Ask for quibbix again.") for i in range(3)]
    rows += [(10, f"Only vexmar knows.{fill} Call bob@solo.example.")]  # one document: its own words are no evidence
    rows += [(20, f"Copied by dunlop.{fill} Call cy@copy.example.")] * 5  # nor are those of copies of one text
    rows += [(None, f"Seen by trilby {w}.{fill} Call di@none.example.") for w in ("here", "there", "above", "below")]  # without an id
    rows += [(100 + i, f"Us and bob write, call or ask again for the notes seen here, there, above or below.{fill} met corp solo copy by only knows copied to cy di none example day {i}") for i in range(200)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = pii.find(frame).collect()
    text = dict(rows)
    assert [_marked(r, text[r.doc_id]) for r in got if r.doc_id in (0, 10, 20)].count(["quibbix", "quibbix"]) == 1
    assert all(_marked(r, text[r.doc_id]) == [] for r in got if r.doc_id in (10, 20))
    assert sum("removed" in r.spans for r in got if r.doc_id is None) == 4
    assert all(r.spans == "" for r in got if (r.doc_id or 0) >= 100)
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert "uibbix" not in clean[0] and "trilby" not in clean[None] and "vexmar" in clean[10] and "dunlop" in clean[20]
    assert clean[10] == text[10].replace("bob@solo.example.", "[EMAIL].")


def _chance(joint, one, two, n):
    k, q = min(one, two), min(max(one, two) / n, 1.0)
    p = joint / k
    if p <= q:
        return 1.0
    entropy = p * math.log(p / q) + ((1 - p) * math.log((1 - p) / (1 - q)) if p < 1 else 0)
    return math.exp(-k * entropy) / (1 - (1 - q) ** k)


def test_pii_terms_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    mails = [f"p{i}@corp.example" for i in range(12)]
    rows = []
    for i in range(300):
        words = [f"w{int(x)}" for x in rng.zipf(1.5, 25) % 400]
        for m in rng.choice(12, rng.integers(0, 3) if i % 3 == 0 else 0, replace=False):
            words += [mails[m], f"nick{m}"] + ([f"pal{m // 3}"] if rng.random() < 0.7 else [])
        rows.append((i, " ".join(words)))
    rows += [(400 + i, rows[0][1]) for i in range(6)] + [(500, None), (501, ""), (502, "")]
    holds = [{s.split(":")[0] + ":" + (t or "")[int(s.split(":")[1]):int(s.split(":")[2])] for s in _base(t or "")} for _, t in rows]
    terms = [{x.lower() for x in re.findall(r"[^\W_]+", t or "") if re.search(r"[^\W\d_]", x)} for _, t in rows]
    texts = [t or "" for _, t in rows]
    n, kinds = len(rows), len(set(texts))
    df, most = {}, {}
    for t in terms:
        for x in t:
            df[x] = df.get(x, 0) + 1
    want = [set() for _ in rows]
    for e in set().union(*holds):
        rowset = [i for i in range(n) if e in holds[i]]
        own = len({texts[i] for i in rowset})
        top = n**0.25 * len(rowset)**0.75 * 1.000000001
        near = {x for i in rowset for x in terms[i] if 1 < df[x] <= top}
        for x in near if own > 1 else ():
            met = [i for i in rowset if x in terms[i]]
            different = len({texts[i] for i in met})
            disclosure = math.log2(n * len(met) / (len(rowset) * df[x])) / math.log2(n / len(rowset))
            if disclosure >= 0.75 and different > 1 and len(near) * _chance(different, own, df[x] - len(met) + different, kinds) <= 0.01:
                for i in met:
                    want[i].add(x)
    got = {r.doc_id: set(_marked(r, dict(rows)[r.doc_id] or "")) for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    cut = lambda i, words: {x for x in words if any(a.group().lower() == x and not any(int(b.split(":")[1]) < a.end() and a.start() < int(b.split(":")[2]) for b in _base(texts[i])) for a in re.finditer(r"[^\W_]+", texts[i]))}
    assert {i: cut(k, want[k]) for k, (i, _) in enumerate(rows)} == got
    marked = set().union(*got.values())
    assert any(x.startswith("nick") for x in marked) and not any(x.startswith("w") for x in marked)


def _base(text):
    return [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]


def test_pii_many_matches_in_one_text(spark):
    """Places and masks over several blocks of matches and of text, and beyond the basic plane."""
    n = 6000
    parts = [f"\U0001F600 note {i} to user{i}@host{i % 7}.example, call +1 555 {1000 + i % 9000:04d} 99" for i in range(n)]
    text = "; ".join(parts)
    frame = spark.createDataFrame([(1, text, len(text)), (2, "x" * 9000 + " a@b.cc " + "y" * 9000, 0)], "doc_id long, text string, n_chars long")
    got = {r.doc_id: r for r in pii.find(frame).collect()}
    spans = got[1].spans.split(",")
    assert got[1].n_email == got[1].n_phone == n and len(spans) == 2 * n
    for s in spans[::397]:
        kind, a, b = s.split(":")
        found = text[int(a):int(b)]
        assert found.endswith(".example") if kind == "email" else found.startswith("+1 555") and found.endswith("99")
    clean = {r.doc_id: r.text for r in pii.sanitise(frame).collect()}
    assert clean[1] == "; ".join(f"\U0001F600 note {i} to [EMAIL], call [PHONE]" for i in range(n))
    assert clean[2] == "x" * 9000 + " [EMAIL] " + "y" * 9000


def test_toxicity_features_are_of_code_points(monkeypatch):
    """Equal n-grams of code points share a slot wherever they stand, also across the parts of a long text."""
    rng = np.random.default_rng(3)
    texts = ["".join(rng.choice(list("aBé \n漢\U0001F600z"), n)) for n in (0, 3, 4, 8, 50, 400, 1)]
    raw = [t.encode() for t in texts]
    data, offs = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    slots, first = toxicity.features(data, offs)
    fold = [re.sub(r"[\t-\r ]", " ", re.sub("[A-Z]", lambda m: m.group().lower(), t)) for t in texts]
    slot_of = {}
    for i, t in enumerate(fold):
        own = slots[first[i]:first[i + 1]].tolist()
        assert own == sorted(set(own))
        grams = {t[a:a + k] for k in toxicity.SIZES for a in range(len(t) - k + 1)}
        for g in grams:
            one, border = toxicity.features(np.frombuffer(g.encode(), np.uint8), np.array([0, len(g.encode())]), (len(g),))
            slot_of[g] = int(one[0])
        assert set(own) == {slot_of[g] for g in grams}
    assert len(set(slot_of.values())) > 0.98 * len(slot_of)
    monkeypatch.setattr(toxicity, "PART", 37)
    again, border = toxicity.features(data, offs)
    assert again.tolist() == slots.tolist() and border.tolist() == first.tolist()
