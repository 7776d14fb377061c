"""Byte-level BPE ids of whole columns of texts.

The pieces that the tokenizer's pattern finds are located with numpy for many texts at
once; each distinct piece is merged once, and a bounded table remembers the ids of short
pieces. Texts so cost array passes plus a call for new pieces. Vocabulary and merges are
read from the tokenizers file; where its ids follow its merge order, tiktoken does the merging
by these ranks, and else tokenizers itself. Tests hold the ids against tokenizers'.
"""

from __future__ import annotations

import functools
import json
import os
import re
import sys
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa

from . import textcore as tc

LETTER, NUMBER, SPACE, OTHER = range(4)
#: Slots of the memory for pieces, and the most ids of a piece it holds.
SLOTS, WIDTH = 1 << 21, 6


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point, by its Unicode properties."""
    import regex

    out = np.full(sys.maxunicode + 1, OTHER, np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, sys.maxunicode + 1)]))
    for code, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\p{White_Space}")):
        out[np.frombuffer("".join(regex.findall(pattern, every)).encode("utf-32-le"), "<u4")] = code
    return out


def piece_starts(code: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern begin: contractions, one optional space with a run, runs of white space.

    code: code points of texts end to end, at: their offsets. True where a piece begins.
    """
    n = len(code)
    kind = classes()[code]
    head = np.zeros(n + 1, bool)
    head[at] = True
    run = head[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    out = run.copy()
    b = np.flatnonzero(run & (kind != SPACE))
    b = b[b > 0]
    b = b[~head[b] & (kind[b - 1] == SPACE)]
    out[b - 1] = True  # the last of a run of white space stands alone, or goes with what follows
    joined = b[code[b - 1] == 32]
    out[joined] = False
    # an apostrophe that begins a piece, alone of its kind, before a contraction's letters
    p = np.flatnonzero(run & (code == 39) & out)
    p = p[p + 1 < n]
    p = p[run[p + 1] & ~head[p + 1] & (kind[p + 1] == LETTER)]
    if len(p):
        one = code[p + 1]
        same = p + 2 < n
        two = np.where(same, code[np.minimum(p + 2, n - 1)], 0)
        two[head[np.minimum(p + 2, n)]] = 0
        pair = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
        single = np.isin(one, (115, 116, 109, 100))
        for hit, size in ((p[single], 2), (p[pair & ~single], 3)):
            out[hit + 1] = False
            after = hit + size
            after = after[after < n]
            out[after] = True
    return out


def merger(path: str):
    """A function from a piece's bytes to its ids, if the file's ids are ranks of its merges; else None."""
    import tiktoken

    model = json.loads(Path(path).read_text("utf-8"))["model"]
    # byte-level vocabularies write the bytes that do not print as the code points from 256 on
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if all(c in byte_of for c in t) and not t.startswith("<|")}
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    made = [model["vocab"]["".join(m)] for m in pairs]
    if made != sorted(set(made)) or len(ranks) != 256 + len(pairs):
        return None
    return tiktoken.Encoding("pieces", pat_str=".", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class PieceEncoder:
    """Encodes texts as the tokenizer file does by default: a literal of a special token has the token's own id."""

    _made: dict[str, "PieceEncoder"] = {}

    @classmethod
    def of(cls, path: str) -> "PieceEncoder":
        if path not in cls._made:
            cls._made[path] = cls(path)
        return cls._made[path]

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = {t.content.encode(): i for i, t in self.tokenizer.get_added_tokens_decoder().items() if t.special}
        plain = all(not (t.lstrip or t.rstrip or t.single_word or t.normalized) for t in self.tokenizer.get_added_tokens_decoder().values())
        if not plain or len(added) < len(self.tokenizer.get_added_tokens_decoder()):
            raise ValueError("added tokens that are not special or take in what is beside them are not supported")
        #: Literals as they are found in a text: the leftmost, of those the longest.
        self.special = re.compile(b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None
        self.special_ids = added
        self.tokenizer.encode_special_tokens = True  # what is between them is text
        self.merge = merger(path)
        self.keys = np.zeros(SLOTS, np.uint64)
        self.size = np.zeros(SLOTS, np.uint8)
        self.ids = np.zeros((SLOTS, WIDTH), np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32)

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        if self.merge:
            return list(map(self.merge, pieces))
        return [e.ids for e in self.tokenizer.encode_batch_fast([x.decode("utf-8") for x in pieces], add_special_tokens=False)]

    def encode_column(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first row, ids, offsets) for runs of whole texts."""
        for first, last, raw, at in tc.slices(column):
            found = [m.span() for m in self.special.finditer(raw.tobytes())] if self.special else []
            # a literal lies in one text: one that would begin in another is text in both
            found = [(a, b) for a, b in found if np.searchsorted(at, a, "right") == np.searchsorted(at, b, "left")]
            yield first, *(self._with_special(raw, at, found) if found else self._slice(raw, at))

    def _with_special(self, raw: np.ndarray, at: np.ndarray, found: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """What is between the literals is encoded as texts of its own; the literals' ids go in between."""
        kept = np.ones(len(raw), bool)
        for a, b in found:
            kept[a:b] = False
        before = np.concatenate(([0], np.cumsum(kept)))
        cuts = np.array([a for a, _ in found])
        parts = np.sort(np.concatenate((before[at], before[cuts])))
        flat, ends = self._slice(raw[kept], parts)
        # ids that come before each literal and each text's beginning, and the literals before it
        ahead = ends[np.searchsorted(parts, before[cuts])]
        out = np.insert(flat, ahead, [self.special_ids[raw[a:b].tobytes()] for a, b in found])
        return out, ends[np.searchsorted(parts, before[at])] + np.searchsorted(cuts, at)

    def _slice(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(raw):
            return np.zeros(0, np.uint32), np.zeros(len(at), np.int64)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # the first byte of each code point
        whole = raw.tobytes()
        code = np.frombuffer(whole.decode("utf-8").encode("utf-32-le"), "<u4")
        first = np.searchsorted(lead, at)
        start = np.flatnonzero(piece_starts(code, first))
        byte = lead[start]
        end = np.append(byte[1:], len(raw))
        key = tc.span(tc.prefix(tc.BYTE_VALUES[raw]), byte, end)
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        slot = (distinct & np.uint64(SLOTS - 1)).astype(np.int64)
        known = (self.keys[slot] == distinct) & (self.size[slot] > 0)
        count = np.where(known, self.size[slot], 0).astype(np.int64)
        new = np.flatnonzero(~known)
        fresh: list[list[int]] = []
        if len(new):
            w = where[new]
            fresh = self._encode([whole[a:b] for a, b in zip(byte[w].tolist(), end[w].tolist(), strict=True)])
            count[new] = [len(x) for x in fresh]
        # ids of the distinct pieces end to end, then of all pieces
        base = np.cumsum(count) - count
        pool = np.empty(int(count.sum()), np.uint32)
        for k in range(WIDTH):
            has = np.flatnonzero(known & (count > k))
            pool[base[has] + k] = self.ids[slot[has], k]
        if len(new):
            pool[np.repeat(base[new], count[new]) + np.arange(count[new].sum()) - np.repeat(np.cumsum(count[new]) - count[new], count[new])] = np.fromiter(chain.from_iterable(fresh), np.uint32)
            keep = new[(count[new] <= WIDTH) & (count[new] > 0)]
            self.keys[slot[keep]], self.size[slot[keep]] = distinct[keep], count[keep]
            for k in range(WIDTH):
                has = keep[count[keep] > k]
                self.ids[slot[has], k] = pool[base[has] + k]
            # two new pieces of one slot: the later key stands, and its ids must too
            lost = keep[self.keys[slot[keep]] != distinct[keep]]
            self.size[slot[lost]] = 0
        each = count[back]
        to = np.cumsum(each) - each
        flat = pool[np.repeat(base[back] - to, each) + np.arange(int(each.sum()))]
        ends = np.append(to, len(flat))
        return flat, ends[np.searchsorted(start, first)]
