"""Exact substring dedup to depth 100 by content-anchored hash groups, where a radix sort of suffixes could stand.

The order of suffixes matters only as far as the threshold, and equal groups at full depth are the repeated
strings, so no digit passes are made. A string is grouped by the hashes of its anchor and of the whole of its phrase
(many strings at once); groups of one drop out. What is left open is grouped by 8 strings, then singly by the hashes
of two halves of 50 bytes. See repeats.py for why this finds the repeated strings, up to collisions of hashes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Units, remove_repeats


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = 100, keep_text: bool = False) -> DataFrame:
    """Removes every byte covered by a min_bytes string that also starts earlier.

    Adds n_tokens (bytes), n_removed, n_spans and kept_sha256. With keep_text the text
    column holds what is left, without the torn bytes of a character cut in half. Null text:
    0 bytes. Null id: kept whole, no source. Same id and text twice: one document, so
    neither removes the other. Shorter texts and empty tables pass through.
    """
    return remove_repeats(docs, Units("bytes", min_bytes, max(1, min(32, min_bytes // 3)), False, 8), id_col, text_col, keep_text)
