"""Vectorised text primitives over Arrow columns: words, rolling hashes, sliding minima.

A slice holds the UTF-8 bytes of some whole documents end to end; arrays run over
the slice, so that the cost of a numpy call is shared by many short documents,
and a document longer than the limit has a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes a slice aims at; arrays of this many 64-bit values stay within a CPU's cache.
SLICE_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS = {"n": 0}

_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> U64(33))
    x *= U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    if _POWERS["n"] < n:
        size = max(n, 2 * _POWERS["n"], SLICE_BYTES + 1)
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            a = np.full(size, base, U64)
            a[0] = 1
            _POWERS[name] = np.multiply.accumulate(a)
        _POWERS["n"] = size
    return _POWERS["up"], _POWERS["down"]


def prefix(values: np.ndarray) -> np.ndarray:
    """Prefix sums of values times powers; span() turns two of them into the hash of a span."""
    out = np.empty(len(values) + 1, U64)
    out[0] = 0
    np.cumsum(values * powers(len(values) + 1)[0][: len(values)], out=out[1:])
    return out


def span(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans [start, end): equal for equal spans, wherever they lie."""
    return mix((sums[end] - sums[start]) * powers(len(sums))[1][start])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values, in log2(w) passes."""
    have, out = 1, x
    while have * 2 <= w:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    if have < w:
        out = np.minimum(out[: len(x) - w + 1], out[w - have :])
    return out


def texts_of(column) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Yields (first row, row after the last, bytes, offsets) of runs of whole documents."""
    raw, at = texts_of(column)
    first, n = 0, len(at) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(at, at[first] + limit, "right")) - 1)
        yield first, last, raw[at[first] : at[last]], at[first : last + 1] - at[first]
        first = last


def word_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of the words `[^\\x20\\x09-\\x0D]+`."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(at), np.int64)
    inside = ~SPACE[raw]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edges = at[:-1][at[:-1] < n]
    before[edges] = False
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edges[edges > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    return start, np.flatnonzero(inside & ~after) + 1, np.searchsorted(start, at)


def word_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return span(prefix(BYTE_VALUES[raw]), start, end) if len(start) else np.zeros(0, U64)
