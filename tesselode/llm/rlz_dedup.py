"""Substring dedup of words by anchored phrase hashes, where a relative Lempel-Ziv parse could stand.

The reference is every document with a smaller id. No block of it is indexed for longest matches and no factor is
extended greedily: phrases, all windows around one anchor, meet by their anchor in one exchange, and neighbouring
equal ones do a factor's work. Windows that phrases leave open are checked one by one, so none across a boundary is
lost. See repeats.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from .repeats import Units, remove_repeats


def rlz_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = 13, keep_text: bool = False) -> DataFrame:
    """Removes every word covered by a window of min_words words that a document with a smaller id holds too.

    Adds n_tokens (words), n_removed, n_spans and kept_sha256 (kept words joined by a space).
    With keep_text the text column holds the kept words where some went, else the text as it
    was. Null text: no words. Null id: kept whole, no source. A document never removes
    its own repeats, nor those of a row with the same id. Shorter texts and empty tables pass through.
    """
    return remove_repeats(docs, Units("words", min_words, max(1, min(5, min_words // 2)), True), id_col, text_col, keep_text)
