"""Terms of texts: runs of letters, digits and non-ASCII characters in lower case, hashed, and a vocabulary to look them up."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import textcore as tc

BREAK = np.ones(256, bool)
BREAK[[*range(48, 58), *range(97, 123), *range(128, 256)]] = False


def lowered(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.utf8_lower(column.cast(pa.large_string()).fill_null(""))


def term_bounds(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of the terms of a slice in lower case."""
    return tc.word_bounds(np.where(BREAK[raw], np.uint8(32), np.uint8(97)), at)


class Vocabulary:
    """Sorted hashes, and where those of each leading bits begin: a look-up reads one place and the few hashes there."""

    def __init__(self, hashes: np.ndarray) -> None:
        self.hashes = np.sort(np.asarray(hashes, np.uint64))
        bits = min(max(len(self.hashes).bit_length() + 1, 10), 22)
        self.shift = np.uint64(64 - bits)
        own = (self.hashes >> self.shift).astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(np.bincount(own, minlength=1 << bits)))).astype(np.int32)

    def find(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices into x that are in the vocabulary, in order, and their numbers there."""
        place = (x >> self.shift).astype(np.int64)
        number = np.full(len(x), -1, np.int64)
        k, end = self.start[place], self.start[place + 1]
        i = np.flatnonzero(k < end)
        while len(i):
            hit = self.hashes[k[i]] == x[i]
            number[i[hit]] = k[i[hit]]
            i = i[~hit]
            k[i] += 1
            i = i[k[i] < end[i]]
        found = np.flatnonzero(number >= 0)
        return found, number[found]
