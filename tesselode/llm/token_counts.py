"""Token counts by count-only Viterbi over a unigram vocabulary.

Texts are split before each space. A distinct word is run once: an Aho-Corasick automaton enumerates the vocabulary's
matches, and for each end the dynamic program carries only the best score, the number of pieces and
whether the last one was unknown. Rules are those of the tokenizers library's Unigram: starts in
rising order, a later candidate replaces only if its score is greater, a character that no piece
covers costs the least score less 10, neighbouring unknown characters are one piece, and
an unknown piece becomes its bytes if the vocabulary has them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .runtime import tune

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLOTS = 1 << 20


def read_pieces(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a SentencePiece model, in the order of their ids."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(p.id_to_piece(i), p.get_score(i)) for i in range(p.get_piece_size())]


class Counter:
    """Counts of words; a bounded table remembers them."""

    _made: dict[str, "Counter"] = {}

    @classmethod
    def of(cls, path: str) -> "Counter":
        if path not in cls._made:
            cls._made[path] = cls(read_pieces(path))
        return cls._made[path]

    def __init__(self, pieces: list[tuple[str, float]], unk_id: int = 0) -> None:
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unk_id))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN_PENALTY
        self.longest = max((len(p) for p, _ in pieces), default=1)
        names = {p for p, _ in pieces}
        self.bytes = all(f"<0x{b:02X}>" in names for b in range(256))
        self.keys, self.counts = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.int32)

    def count(self, word: str) -> int:
        """Tokens of the best segmentation. Matches come by their ends, the longest first, which is also the order of ties; a ring as long as the longest piece holds all that they need, however long the word."""
        ring = self.longest + 1
        best, whole, open_ = [0.0] * ring, [0] * ring, [0] * ring
        e, found, single = 1, None, False

        def close() -> None:
            """Place e has had its matches: a character that is no piece is unknown, its bytes (or one) join an open run."""
            nonlocal e, found, single
            s = (e - 1) % ring
            if not single and (found is None or best[s] + self.unknown > found[0]):
                found = (best[s] + self.unknown, whole[s], open_[s] + len(word[e - 1].encode()) if self.bytes else 1)
            best[e % ring], whole[e % ring], open_[e % ring] = found
            e, found, single = e + 1, None, False

        for end, (size, score, _) in self.automaton.iter(word):
            while e <= end:
                close()
            s = (e - size) % ring
            single |= size == 1
            if found is None or best[s] + score > found[0]:
                found = (best[s] + score, whole[s] + open_[s] + 1, 0)
        while e <= len(word):
            close()
        return whole[len(word) % ring] + open_[len(word) % ring]

    def count_slice(self, raw: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Tokens of each text of a slice."""
        n = len(at) - 1
        full = np.flatnonzero(np.diff(at))
        if not len(full):
            return np.zeros(n, np.int64)
        head = np.zeros(len(raw), bool)
        head[at[:-1][full]] = True
        head |= raw == 32
        start = np.flatnonzero(head)
        end = np.append(start[1:], len(raw))
        body = start + (raw[start] == 32)  # the mark stands for the space, or before the text
        key = tc.mix(tc.span(tc.prefix(tc.BYTE_VALUES[raw]), body, end) + np.uint64(1))
        distinct, where, back = np.unique(key, return_index=True, return_inverse=True)
        slot = (distinct & np.uint64(SLOTS - 1)).astype(np.int64)
        known = self.keys[slot] == distinct
        counts = np.where(known, self.counts[slot], 0).astype(np.int64)
        new, whole = np.flatnonzero(~known), raw.tobytes()
        counts[new] = [self.count(MARK + whole[a:b].decode("utf-8")) for a, b in zip(body[where[new]].tolist(), end[where[new]].tolist(), strict=True)]
        self.keys[slot[new]], self.counts[slot[new]] = distinct[new], counts[new]
        lost = new[self.keys[slot[new]] == distinct[new]]
        self.counts[slot[lost]] = counts[lost]  # where two new words share a slot, the one that stands
        doc = np.searchsorted(at, start, "right") - 1
        return np.bincount(doc, counts[back], n).astype(np.int64)


def _count_rows(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter.of(path)
        for batch in batches:
            text = pc.replace_substring(batch.column(1).cast(pa.large_string()).fill_null(""), MARK, " ")
            for first, last, raw, at in tc.slices(text):
                yield pa.RecordBatch.from_arrays([batch.column(0)[first:last], batch.column(2)[first:last], pa.array(counter.count_slice(raw, at))], ["doc_id", "n_chars", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, n_tokens for every row; null and empty texts have 0. Null ids and repeated rows are rows like others."""
    tune(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.coalesce(F.char_length(text_col), F.lit(0)).cast("long").alias("n_chars"))
    return rows.mapInArrow(_count_rows(path), "doc_id long, n_chars long, n_tokens long")
