"""Personal data: base patterns and information-theoretic sanitisation, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of four patterns (email, ip,
card, phone) that pass their check (octets, Luhn, digit count). Every found value
is a protected entity. The terms of a text (letters and digits, a letter among them)
can give it away even when the value is masked. With N documents, df documents
holding an entity or a term and joint documents holding both, the corpus says how
much of the entity's information a term reveals:

    disclosure = log2(N * joint / (df(entity) * df(term))) / log2(N / df(entity))

1 means the term occurs nowhere else. Terms from ``REMOVE`` on are removed and those
from ``GENERALISE`` on generalised (to the entity's kind) if the co-occurrence is no
chance. That is judged on different texts, so copies are no evidence of their own: a
term and an entity that met at least once in n texts would by chance meet in joint
or more of them with a probability of at most

    exp(-k * KL(joint / k, q)) / (1 - (1 - q)**k)

(k: the texts of the rarer one, q: the share of texts with the other, KL: relative
entropy of two coins). Times the number of terms weighed for the entity this must
stay within ``CHANCE``. One meeting has probability 1, so the many words that only
one text holds tell nothing. Each occurrence outside base spans, in every document
that holds the entity, becomes a span beside the base ones.

Positions come from ``split`` and ``regexp_extract_all`` of one pattern: the gaps'
and the matches' lengths in code points add up to the starts, in blocks of matches, so
the work grows with the text and not with the square of its matches. The patterns hold
possessive loops and start a run only at its first character (or where the last
match ended), so long runs are read once and no loop recurses.

Defined cases: a null text is an empty text without spans; repeated rows give
equal rows and count as documents each, with or without a doc_id; an entity in every
document has no information and reveals nothing; an empty table gives no rows; other columns are
ignored by ``find`` and kept by ``sanitise``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepcast.llm.scratch import written

KINDS = ("email", "ip", "card", "phone", "general", "removed")
CHANCE = 0.01
GENERALISE, REMOVE = 0.75, 0.9
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"[0-9](?<![0-9][0-9])[0-9]*+\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = r"[\p{L}\p{N}]++"
SPAN = "struct<s:int,k:int,e:int,v:string>"
BLOCK = 512  # matches, or spans, to a block
TEXT_BLOCK = 4096  # code points


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _let(value: str, name: str, body: str) -> str:
    """SQL: ``body`` with ``name`` for ``value``, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def _blocked(items: str, start: str, ahead: str, step: str, out: str) -> str:
    """SQL: fold of ``items`` whose state is a place ``at`` and a list ``out`` (SQL type), in blocks.

    ``ahead`` is the place after one block ``k`` begun at place ``s``; ``step`` the
    state after one item ``x`` in state ``acc``. Each list is built within its
    block, because appending copies the list.
    """
    cut = f"transform(sequence(0, (size(z) - 1) div {BLOCK}), b -> slice(z, b * {BLOCK} + 1, {BLOCK}))"
    starts = f"aggregate(blocks, named_struct('at', cast({start} as int), 'out', cast(array() as array<int>)), (a, k) -> named_struct('at', {ahead.format(s='a.at')}, 'out', concat(a.out, array(a.at))), a -> a.out)"
    inner = f"aggregate(k, named_struct('at', s, 'out', cast(array() as array<{out}>)), (acc, x) -> {step}, acc -> acc.out)"
    return _let(items, "z", _let(cut, "blocks", f"flatten(zip_with(blocks, {starts}, (k, s) -> {inner}))"))


def _places(text: str, matches: str, pattern: str, kind: int) -> str:
    """SQL: spans of all matches of ``pattern`` in ``text``, from the lengths of gaps and matches."""
    gaps = f"split({text}, {_sql(pattern)}, -1)"
    zipped = f"zip_with(slice({gaps}, 1, size({matches})), {matches}, (g, m) -> named_struct('g', length(g), 'm', m))"
    step = f"named_struct('at', acc.at + x.g + length(x.m), 'out', concat(acc.out, array(named_struct('s', acc.at + x.g, 'k', {kind}, 'e', acc.at + x.g + length(x.m), 'v', x.m))))"
    ahead = "aggregate(k, {s}, (t, y) -> t + y.g + length(y.m))"
    return f"if(size({matches}) = 0, cast(array() as array<{SPAN}>), {_blocked(zipped, '0', ahead, step, SPAN)})"


_DIGITS = "translate(x.v, ' ().+-', '')"
_LUHN = "aggregate(sequence(1, length({d})), 0, (t, i) -> t + if(i % 2 = 1, ascii(substring(reverse({d}), i, 1)) - 48, (ascii(substring(reverse({d}), i, 1)) - 48) * 2 - if(ascii(substring(reverse({d}), i, 1)) > 52, 9, 0))) % 10 = 0".format(d=_DIGITS)
_CHECK = {
    "email": "true",
    "ip": "forall(split(x.v, '[.]'), p -> length(ltrim('0', p)) <= 3 and cast(concat('0', right(ltrim('0', p), 3)) as int) <= 255)",
    "card": f"if(length({_DIGITS}) between 12 and 19, {_LUHN}, false)",
    "phone": f"length({_DIGITS}) between 9 and 15",
}
_GUARD = {"email": "instr(t, '@') > 0", "ip": "true", "card": "true", "phone": "instr(t, '+') > 0"}


def with_base(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``t`` (text, null as empty) and ``base`` (valid base spans by start, then kind)."""
    df = docs.withColumn("t", F.coalesce(F.col("text").cast("string"), F.lit("")))
    for kind, pattern in PATTERNS.items():
        df = df.withColumn(f"m_{kind}", F.expr(f"if({_GUARD[kind]}, regexp_extract_all(t, {_sql(pattern)}, 0), cast(array() as array<string>))"))
    valid = [f"filter({_places('t', f'm_{kind}', pattern, i)}, x -> {_CHECK[kind]})" for i, (kind, pattern) in enumerate(PATTERNS.items())]
    found = " or ".join(f"size(m_{kind}) > 0" for kind in PATTERNS)
    df = df.withColumn("base", F.expr(f"if({found}, array_sort(concat({', '.join(valid)})), cast(array() as array<{SPAN}>))"))
    return df.drop(*(f"m_{kind}" for kind in PATTERNS))


def _terms(text: str) -> str:
    """SQL: the distinct terms of ``text``."""
    return f"array_distinct(transform(regexp_extract_all({text}, {_sql(TERM)}, 0), x -> lower(x)))"


def _classes(light: DataFrame) -> DataFrame:
    """(row, h, class, kind, df_entity, texts_entity): the entities of each row that lie in two texts or more.

    Entities of the same rows have the same counts beside every term, so they are
    one class (of the first of their kinds), known by two hashes of its rows.
    """
    entity = light.where("size(base) > 0").select("row", "h", F.explode(F.expr("array_distinct(transform(base, x -> named_struct('kind', x.k, 'value', lower(x.v))))")).alias("x")).select("row", "h", "x.kind", "x.value")
    rows = F.struct(F.bit_xor(F.xxhash64("row")).alias("a"), F.bit_xor(F.xxhash64("row", F.lit(1))).alias("b"))
    counts = entity.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("df_entity"), F.countDistinct("h").alias("texts_entity"), rows.alias("class")).where("texts_entity > 1")
    held = entity.join(counts, ["kind", "value"])
    return held.groupBy("row", "h", "class", "df_entity", "texts_entity").agg(F.min("kind").alias("kind"))


def _pairs(light: DataFrame, classes: DataFrame, terms: DataFrame, n: int) -> DataFrame:
    """(row, h, class, kind, df_entity, texts_entity, term, df_term): entities and terms of one row that can reach GENERALISE.

    joint is at most the smaller df, so no term beyond N**(1 - GENERALISE) *
    df(entity)**GENERALISE documents can; common terms go before the pairs are made,
    and so do terms of one document.
    """
    held = classes.withColumn("most", F.expr(f"pow({n}D, {1 - GENERALISE}D) * pow(df_entity, {GENERALISE}D) * 1.000000001D"))
    limits = held.groupBy("row").agg(F.max("most").alias("row_most"))
    words = light.where("t is not null").join(limits, "row").select("row", "row_most", F.explode(F.expr(_terms("t"))).alias("term")).where("term rlike '\\\\p{L}'")
    rare = words.join(terms.where("df_term > 1"), "term").where("df_term <= row_most")
    return rare.drop("row_most").join(held, "row").where("df_term <= most").drop("most")


def disclosures(pairs: DataFrame, n: int, texts: int) -> DataFrame:
    """(class, term, disclosure) of the terms that reach GENERALISE and are no chance; ``texts``: different texts."""
    joint = pairs.groupBy("class", "term").agg(F.count(F.lit(1)).alias("joint"), F.countDistinct("h").alias("joint_texts"), *(F.max(c).alias(c) for c in ("df_entity", "texts_entity", "df_term")))
    weighed = joint.groupBy("class").agg(F.count(F.lit(1)).alias("weighed"))
    disclosure = F.expr(f"if({n} > df_entity, log2({n} * joint / (df_entity * df_term)) / log2({n} / df_entity), 0D)")
    near = joint.withColumn("disclosure", disclosure).where(F.col("disclosure") >= GENERALISE).where("joint_texts > 1")
    # copies among the joint rows are known; the term's other rows count as texts of their own
    held = near.withColumn("texts_term", F.expr("df_term - joint + joint_texts")).withColumn("k", F.expr("least(texts_entity, texts_term)")).withColumn("q", F.expr(f"least(greatest(texts_entity, texts_term) / {texts}D, 1D)")).withColumn("p", F.expr("joint_texts / double(k)"))
    entropy = "(p * ln(p / q) + if(p < 1, (1 - p) * ln((1 - p) / (1 - q)), 0D))"
    chance = F.expr(f"if(p <= q, 1D, exp(-k * {entropy}) / -expm1(k * log1p(-q)))")
    return held.withColumn("chance", chance).join(weighed, "class").where(F.col("chance") * F.col("weighed") <= CHANCE).select("class", "term", "disclosure")


def _analysed(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(base spans of every row, revealing term spans by doc_id and text hash)."""
    based = with_base(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).withColumn("h", F.xxhash64("t"))
    light = written(based.select(F.monotonically_increasing_id().alias("row"), "doc_id", "h", "base", F.expr("if(size(base) > 0, t, null)").alias("t")), "pii-base")
    n, texts = light.agg(F.count(F.lit(1)), F.countDistinct("h")).first()
    terms = docs.select(F.explode(F.expr(_terms("cast(text as string)"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df_term"))
    pairs = written(_pairs(light, written(_classes(light), "pii-classes"), terms, n), "pii-pairs")
    hits = pairs.join(disclosures(pairs, n, texts), ["class", "term"]).groupBy("row", "term").agg(F.max(F.struct("disclosure", (-F.col("kind")).alias("about"))).alias("x"))
    hits = written(hits.select("row", "term", "x.disclosure", (-F.col("x.about")).alias("about")), "pii-hits")
    return light.drop("row"), written(_extra(light, hits), "pii-extra")


def _extra(light: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, h, extra): the spans of each row's terms in ``hits``, outside its base spans."""
    rows = light.join(hits.select("row").distinct(), "row")
    spot = rows.select("row", F.expr(f"regexp_extract_all(t, {_sql(TERM)}, 0)").alias("m"), "t").select("row", F.explode(F.expr(_places("t", "m", TERM, 0))).alias("x"))
    names = ", ".join(map(repr, KINDS[:4]))
    kind = f"if(disclosure >= {REMOVE}D, {KINDS.index('removed')}, {KINDS.index('general')})"
    span = F.expr(f"named_struct('s', x.s, 'k', {kind}, 'e', x.e, 'v', element_at(array({names}), about + 1))")
    found = spot.withColumn("term", F.expr("lower(x.v)")).join(hits, ["row", "term"]).groupBy("row").agg(F.collect_list(span).alias("all"))
    free = F.expr("filter(all, x -> not exists(base, y -> y.s < x.e and x.s < y.e))")
    return rows.select("row", "doc_id", "h", "base").join(found, "row").select("doc_id", "h", F.array_sort(free).alias("extra")).groupBy("doc_id", "h").agg(F.first("extra").alias("extra"))


def _with_extra(df: DataFrame, extra: DataFrame) -> DataFrame:
    """Left join of the few rows with revealing terms; null doc_ids match each other."""
    e = extra.select(F.col("doc_id").alias("__doc"), F.col("h").alias("__h"), "extra")
    return df.join(e, (F.col("h") == F.col("__h")) & F.col("doc_id").cast("long").eqNullSafe(F.col("__doc")), "left").drop("__doc", "__h").withColumn("extra", F.coalesce("extra", F.expr(f"cast(array() as array<{SPAN}>)")))


def _listed(column: str) -> Column:
    names = ", ".join(map(repr, KINDS))
    return F.expr(f"array_join(transform({column}, x -> concat(element_at(array({names}), x.k + 1), ':', x.s, ':', x.e)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row."""
    light, extra = _analysed(docs)
    both = _with_extra(light.drop("t"), extra)
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) as long)").alias(f"n_{kind}") for i, kind in enumerate(PATTERNS)]
    return both.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("array_sort(concat(base, extra))").alias("spans"))


def sanitise(docs: DataFrame) -> DataFrame:
    """``docs`` with spans masked in ``text`` (``n_chars``, if there, is counted anew); all other columns as they are.

    Base spans become [EMAIL], [IP], [CARD], [PHONE]; generalised terms become the
    kind of the entity they tell of, as [ABOUT EMAIL]; removed ones go. Touching
    spans that overlap are masked as one, with the first one's mask.
    """
    _, extra = _analysed(docs)
    own = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    based = _with_extra(with_base(own).withColumn("h", F.xxhash64("t")), extra)
    names = ", ".join(f"'[{k.upper()}]'" for k in KINDS[:4])
    mask = f"case when x.k < 4 then element_at(array({names}), x.k + 1) when x.k = 4 then concat('[ABOUT ', upper(x.v), ']') else '' end"
    cut = f"regexp_extract_all(t, '(?s).{{1,{TEXT_BLOCK}}}', 0)"
    between = f"if(x.s > acc.at, substring(array_join(slice(chunks, acc.at div {TEXT_BLOCK} + 1, x.s div {TEXT_BLOCK} - acc.at div {TEXT_BLOCK} + 1), ''), acc.at % {TEXT_BLOCK} + 1, x.s - acc.at), '')"
    step = f"named_struct('at', greatest(acc.at, x.e), 'out', if(x.s < acc.at, acc.out, concat(acc.out, array({between}, {mask}))))"
    pieces = _blocked("spans", "0", "greatest({s}, array_max(transform(k, y -> y.e)))", step, "string")
    tail = "substring(t, array_max(transform(spans, y -> y.e)) + 1)"
    masked = _let("array_sort(concat(base, extra))", "spans", _let(cut, "chunks", f"concat(array_join({pieces}, ''), {tail})"))
    whole = f"if(size(base) + size(extra) = 0, t, {masked})"
    out = based.withColumn("masked", F.when(F.col("text").isNull(), None).otherwise(F.expr(whole)))
    new = {"text": F.col("masked")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.coalesce(F.length("masked"), F.lit(0)).cast(docs.schema["n_chars"].dataType)
    return out.select(*(new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))
