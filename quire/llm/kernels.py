"""Vectorised word kernels over Arrow string columns.

A column's UTF-8 bytes are handled as one array: words are found by a table lookup on
bytes (all separators are ASCII), and hashes of words and of word windows come from
prefix sums of a polynomial modulo 2**64, so no Python code runs per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import worker_cache

U = np.uint64
SLICE_BYTES = 1 << 20
#: Bytes of words that are hashed at once, about.
HASH_BYTES = 1 << 18


def arrow_bytes(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and int64 offsets; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `limit` bytes of text, one row at least: memory depends on the longest text, not on the batch."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).cast(pa.int64()))
    part, at = np.cumsum(sizes) // limit, 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(part, part[at], "right")))
        yield batch.slice(at, to - at)
        at = to


def _table(separators: bytes) -> np.ndarray:
    table = np.ones(256, bool)
    table[list(separators)] = False
    return table


#: Words are `[^\x20\x09-\x0D]+`.
NOT_SPACE = _table(b" \t\n\x0b\x0c\r")
#: Words are `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of text whose A-Z are lowered: digits, a-z and all beyond ASCII.
ALNUM = _table(bytes(x for x in range(128) if not (48 <= x <= 57 or 97 <= x <= 122)))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, off: np.ndarray, table: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words in the data, and the offsets of rows in these; no word spans two rows."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(off), np.int64)
    inside = table[data]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    at = off[:-1][off[:-1] < n]
    first[at] = inside[at]
    at = off[1:][off[1:] > 0] - 1
    last[at] = inside[at]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, e, np.searchsorted(s, off).astype(np.int64)


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, up to n of them."""
    held = worker_cache()
    if "powers" not in held or len(held["powers"][0]) < n:
        base = 0x9E3779B97F4A7C15
        size = max(n, 2 * HASH_BYTES, 2 * len(held["powers"][0]) if "powers" in held else 0)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, U)
            p[0] = 1
            both.append(np.cumprod(p, dtype=U))
        held["powers"] = tuple(both)
    p, q = held["powers"]
    return p[:n], q[:n]


def letters(data: np.ndarray) -> np.ndarray:
    """64-bit values of bytes."""
    return mix(np.arange(1, 257, dtype=U) * U(0xD1B54A32D192ED03))[data]


def span_hashes(values: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [s, e) of an array of 64-bit values."""
    p, q = _powers(len(values) + 1)
    sums = np.zeros(len(values) + 1, U)
    np.cumsum(values * p[: len(values)], out=sums[1:])
    return mix((sums[e] - sums[s]) * q[s] + (e - s).astype(U))


def word_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words [s, e) of bytes, in their order; bytes are widened part by part, never within a word."""
    out, at = np.empty(len(s), U), 0
    while at < len(s):
        to = max(at + 1, int(np.searchsorted(e, s[at] + HASH_BYTES)))
        first = s[at]
        out[at:to] = span_hashes(letters(data[first : e[to - 1]]), s[at:to] - first, e[at:to] - first)
        at = to
    return out


def window_starts(woff: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Where windows of k words begin that stay inside a row, and how many each row has."""
    counts = np.maximum(np.diff(woff) - (k - 1), 0)
    return ranges(woff[:-1], counts), counts


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers starts[i], starts[i] + 1, ... of each i, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.int64)
    before = np.cumsum(counts) - counts
    return np.arange(total, dtype=np.int64) - np.repeat(before - starts, counts)


def window_hashes(hashes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return span_hashes(hashes, starts, starts + k)


def shingle_sets(column, k: int) -> Iterator[np.ndarray]:
    """For each row the ascending distinct hashes of its k-word shingles, A-Z lowered; of a shorter row its whole word sequence as one."""
    data, off = arrow_bytes(column)
    data = LOWER[data]
    s, e, woff = words(data, off)
    hashes = word_hashes(data, s, e)
    n = np.diff(woff)
    counts = np.where(n >= k, n - (k - 1), np.minimum(n, 1))
    at = ranges(woff[:-1], counts)
    found = span_hashes(hashes, at, at + np.minimum(np.repeat(n, counts), k))
    bounds = np.concatenate(([0], np.cumsum(counts)))
    for i in range(len(n)):
        yield np.unique(found[bounds[i] : bounds[i + 1]])
