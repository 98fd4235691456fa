"""Compression bands: quality rules from zstandard ratios.

A text's ratio is its zstandard size over its bytes. Repetitive text falls
below the lower limit for its length, incompressible text (encoded blobs, random
characters) above the upper one; the limits depend on the length, as short
texts compress less. Fixed chunks are measured alone against the limits for
their own length, so a long text with a large bad part is caught although its
whole ratio is ordinary. Texts shorter than the first band are not judged.

Beside the verdict stand plain counts (words, symbols, duplicate lines,
repeated 8-word windows) and a base rule on them. Words are runs of bytes other
than ``\\x20 \\x09-\\x0D``.

Defined cases: a null text is an empty one; an empty text has zero counts, null
ratios and fails the base rule; repeated rows give repeated rows; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prepcast.llm.text import BYTE, mix, per_text, prefix_hash, slices, span_hash, text_buffer, word_bounds, word_hashes

#: bytes from, lowest and highest ratio that is kept.
BANDS = ((64, 0.40, 1.20), (256, 0.35, 0.90), (1024, 0.30, 0.80), (4096, 0.25, 0.72), (16384, 0.20, 0.70))
CHUNK = 4096
BAD_CHUNKS = 0.25
LEVEL = 3
MIN_WORDS = 20
REPEAT_PERCENT = 30
WINDOW_WORDS = 8
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, bad_chunk_share double, verdict string"
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True


def repeated_words(words: np.ndarray, first: np.ndarray, k: int = WINDOW_WORDS) -> np.ndarray:
    """Per text: words inside k-word windows that occur twice or more in it."""
    counts = np.diff(first)
    n = np.maximum(counts - k + 1, 0)
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.cumsum(n) - n
    start = first[:-1][text] + np.arange(len(text)) - begin[text]
    key = span_hash(prefix_hash(words), start, start + k)
    key = mix(key + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(words) + 1, np.int64)
    np.add.at(step, start[twice], 1)
    np.add.at(step, start[twice] + k, -1)
    return per_text(np.cumsum(step)[:-1] > 0, first)


def duplicate_lines(data: np.ndarray, offs: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Per text: \\n-split lines with a word that equal an earlier line of the text."""
    a, b, first = word_bounds(data, offs, _NEWLINE)  # empty lines hold no word and may go
    text = np.repeat(np.arange(len(offs) - 1), np.diff(first))
    wordy = np.searchsorted(starts, b) > np.searchsorted(starts, a)
    key = span_hash(prefix_hash(BYTE[data]), a, b)[wordy]
    key = mix(key + text[wordy].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    again = np.ones(len(key), bool)
    again[np.unique(key, return_index=True)[1]] = False
    return np.bincount(text[wordy][again], minlength=len(offs) - 1)


def band(size: int) -> tuple[float, float] | None:
    found = None
    for least, low, high in BANDS:
        if size >= least:
            found = low, high
    return found


def outside(zip_, part: bytes) -> bool:
    """Whether a part's ratio is beyond the limits for its length."""
    limits = band(len(part))
    return limits is not None and not limits[0] <= len(zip_.compress(part)) / len(part) <= limits[1]


def verdict(zip_, raw: bytes) -> tuple[float | None, float | None, str]:
    """(ratio, share of bytes in bad chunks, verdict) of one text."""
    if not raw:
        return None, None, "short"
    ratio = len(zip_.compress(raw)) / len(raw)
    limits = band(len(raw))
    if limits is None:
        return ratio, None, "short"
    share = None
    if len(raw) > CHUNK:
        last = len(raw) - len(raw) % CHUNK
        bad = sum(CHUNK for at in range(0, last, CHUNK) if outside(zip_, raw[at:at + CHUNK]))
        if last < len(raw) and (outside(zip_, raw[last:]) or outside(zip_, raw[-CHUNK:])):
            bad += len(raw) - last
        share = bad / len(raw)
    if ratio < limits[0]:
        return ratio, share, "repetitive"
    if ratio > limits[1]:
        return ratio, share, "incompressible"
    return ratio, share, "bad chunks" if share is not None and share > BAD_CHUNKS else "ok"


def assess(docs: DataFrame) -> DataFrame:
    """One row per document: counts, base rule, ratios and verdict."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        zip_ = zstandard.ZstdCompressor(level=LEVEL)
        for batch in slices(batches, "text", 4 << 20):
            data, offs = text_buffer(batch.column("text"))
            starts, ends, first = word_bounds(data, offs)
            words = word_hashes(data, starts, ends, lower=False)
            n_words = np.diff(first)
            points = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=points[1:])
            repeat = repeated_words(words, first)
            failed = (n_words < MIN_WORDS) | (100 * repeat > REPEAT_PERCENT * n_words)
            raw = data.tobytes()
            found = [verdict(zip_, raw[a:b]) for a, b in zip(offs, offs[1:])]
            ok = np.array([v[2] in ("ok", "short") for v in found], bool)
            cols = [batch.column("doc_id"), pa.array(n_words), pa.array(per_text(points[ends] - points[starts], first)), pa.array(per_text(_SYMBOL[data], offs)), pa.array(duplicate_lines(data, offs, starts)), pa.array(repeat), pa.array(failed), pa.array(ok & ~failed)]
            cols += [pa.array([v[0] for v in found], pa.float64()), pa.array([v[1] for v in found], pa.float64()), pa.array([v[2] for v in found], pa.string())]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "ratio", "bad_chunk_share", "verdict"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
