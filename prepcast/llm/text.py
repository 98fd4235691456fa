"""Vectorised text helpers shared by the operators (numpy over Arrow buffers).

All helpers work on a slice of an Arrow string column: ``data`` is the UTF-8
bytes of its texts one after the other, ``offs`` the n + 1 text borders.
Words are maximal runs of bytes outside ``\\x20 \\x09-\\x0D``; none crosses a text
border. A null text counts as an empty one.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_RNG = np.random.default_rng(20240229)
BYTE = _RNG.integers(0, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
_U = np.uint64


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offs) of a string column; null texts are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + n + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def trimmed() -> None:
    """Give what this Python worker has freed back to the system, where its C library can.

    Workers outlive their tasks and stages. Arrays that were freed stay in the C library's
    and in Arrow's pools otherwise, beside what the next stage takes.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds whole texts of at most ``max_bytes`` together (or one longer text).

    Before the first and after the last, the worker gives back what it has freed.
    """
    trimmed()
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = text_buffer(batch.column(column))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + max_bytes, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
    trimmed()


def word_bounds(data: np.ndarray, offs: np.ndarray, sep: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first): byte borders of every word; text i holds words first[i]:first[i + 1]."""
    inside = ~sep[data]
    before = np.zeros(len(data) + 1, bool)
    before[1:] = inside
    before[offs] = False
    after = np.zeros(len(data) + 1, bool)
    after[:-1] = inside
    after[offs] = False
    starts = np.flatnonzero(inside & ~before[:-1])
    ends = np.flatnonzero(inside & ~after[1:]) + 1
    return starts, ends, np.searchsorted(starts, offs)


_STEP = 1 << 16
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(low, high) with base**i = low[i % 2**16] * high[i // 2**16] modulo 2**64 for i < n: half a megabyte each for any text."""
    low, high = _POW.get(base, (None, np.zeros(0, _U)))
    if len(high) * _STEP < n:
        times = lambda b, m: np.cumprod(np.concatenate([[_U(1)], np.full(m - 1, b, _U)]), dtype=_U)
        low, high = times(base, _STEP), times(pow(base, _STEP, 2**64), max(64, 2 * -(-n // _STEP)))
        _POW[base] = low, high
    return low, high


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over the 64 output bits."""
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> _U(29))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(32))


def prefix_hash(values: np.ndarray) -> np.ndarray:
    """Running polynomial sums; ``span_hash`` turns two of them into the hash of a span."""
    n = len(values)
    low, high = _powers(BASE, n)
    out = np.zeros(n + 1, _U)
    for a in range(0, n, _STEP):
        b = min(a + _STEP, n)
        np.multiply(values[a:b], low[:b - a], out=out[a + 1:b + 1])
        out[a + 1:b + 1] *= high[a // _STEP]
    np.cumsum(out[1:], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low, high = _powers(pow(BASE, -1, 2**64), len(prefix))
    return mix((prefix[ends] - prefix[starts]) * low[starts % _STEP] * high[starts // _STEP] + (ends - starts).astype(_U))


def window_hashes(prefix: np.ndarray, size: int) -> np.ndarray:
    """``span_hash`` of ``size`` values from every place on, block by block in the processor's cache."""
    n = max(len(prefix) - size, 0)
    low, high = _powers(pow(BASE, -1, 2**64), len(prefix))
    out = np.empty(n, _U)
    for a in range(0, n, _STEP):
        b = min(a + _STEP, n)
        part = prefix[a + size:b + size] - prefix[a:b]
        part *= low[:b - a]
        part *= high[a // _STEP]
        part += _U(size)
        out[a:b] = mix(part)
    return out


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hash of every word; A-Z count as a-z when ``lower``."""
    return span_hash(prefix_hash(BYTE[LOWER[data] if lower else data]), starts, ends)


def shingle_hashes(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every k-word shingle; a text of 1 to k - 1 words gives one shingle of them all."""
    counts = np.diff(first)
    prefix = prefix_hash(words)
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    text = np.repeat(np.arange(len(counts)), n)
    begin = np.zeros(len(n) + 1, np.int64)
    np.cumsum(n, out=begin[1:])
    start = first[:-1][text] + np.arange(begin[-1]) - begin[:-1][text]
    end = np.minimum(start + k, first[1:][text])
    return span_hash(prefix, start, end), text


def per_text(flags: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Sum of a per-item array within each text."""
    total = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "bui" else np.float64)
    np.cumsum(flags, out=total[1:])
    return total[offs[1:]] - total[offs[:-1]]
