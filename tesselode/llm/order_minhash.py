"""Order MinHash fingerprints of texts, of their edited texts, and likeness along the id order.

For each of M functions: the L occurrence-numbered k-mers with the least hashes, kept in text
order, hashed as a tuple. Two texts agree in a function with a probability that falls with
their edit distance: a k-mer that is lost, gained or moved past another changes the tuple. A
k-mer is K units: words `[^\\x20\\x09-\\x0D]+` of up to LONG bytes, and each code point of longer ones, so that text without
blanks has k-mers too. A text of fewer units is one k-mer.

Neighbours by id are found without gathering the table: the id range is cut at quantiles, each
range is sorted in one task and the largest row of a range also goes to the range above it.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .repeats import _batch
from .runtime import partitions, tune

K, L, M = 3, 2, 64
#: Bytes of a word above which its code points are the units.
LONG = 32

_rng = np.random.default_rng(11)
_MUL = (_rng.integers(0, 1 << 31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_MUL2 = (_rng.integers(0, 1 << 31, M, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, M, dtype=np.uint32)
_LOW = np.uint64(0xFFFFFFFF)


def units(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and per-document offsets of the words of a slice, with code points in place of long words."""
    start, end, of = tc.word_bounds(raw, at)
    long = end - start > LONG
    if not long.any():
        return start, end, of
    inside = np.zeros(len(raw) + 1, np.int8)
    inside[start[long]] += 1
    inside[end[long]] -= 1
    lead = np.flatnonzero((np.cumsum(inside[:-1], dtype=np.int8) > 0) & ((raw & 0xC0) != 0x80))
    ends = np.append(lead[1:], len(raw))
    word = np.searchsorted(start[long], lead, "right") - 1
    ends = np.minimum(ends, end[long][word])
    starts = np.concatenate((start[~long], lead))
    order = np.argsort(starts)
    return starts[order], np.concatenate((end[~long], ends))[order], np.searchsorted(starts[order], at)


def kmers(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashes of the occurrence-numbered k-mers of each text of a slice, in text order."""
    start, end, of = units(raw, at)
    words = tc.word_hashes(raw, start, end)
    sums, out = tc.prefix(words), []
    p = np.arange(max(0, len(words) - K + 1))
    grams = tc.span(sums, p, p + K) if len(p) else np.zeros(0, np.uint64)
    for lo, hi in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if hi - lo < K:
            out.append(tc.span(sums, np.array([lo]), np.array([hi])) if hi > lo else np.zeros(0, np.uint64))
            continue
        x = grams[lo : hi - K + 1]
        order = np.argsort(x, kind="stable")
        y = x[order]
        new = np.concatenate(([True], y[1:] != y[:-1]))
        if not new.all():
            first = np.flatnonzero(new)
            nth = np.empty(len(x), np.uint64)
            nth[order] = (np.arange(len(x)) - np.repeat(first, np.diff(np.append(first, len(x))))).astype(np.uint64)
            x = np.where(nth > 0, tc.mix(x + nth * np.uint64(0x9E3779B97F4A7C15)), x)
        out.append(x)
    return out


def fingerprint(x: np.ndarray) -> str:
    """M numbers of 16 bits as hexadecimal; empty for an empty text."""
    if not len(x):
        return ""
    # hash above, place below: the least values are the least hashes, the leftmost of equals
    best = np.full((M, L), 0xFFFFFFFFFFFFFFFF, np.uint64)
    high, low = (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)
    for i in range(0, len(x), 2048):
        h = _MUL[:, None] * high[None, i : i + 2048]
        h += _MUL2[:, None] * low[None, i : i + 2048]
        h += _ADD[:, None]
        rows, found = np.arange(M), []
        for _ in range(min(L, h.shape[1])):
            j = h.argmin(axis=1)
            found.append((h[rows, j].astype(np.uint64) << np.uint64(32)) | (j + i).astype(np.uint64))
            h[rows, j] = 0xFFFFFFFF
        best = np.sort(np.column_stack((best, *found)), axis=1)[:, :L]
    n = min(L, len(x))
    place = np.sort((best[:, :n] & _LOW).astype(np.int64), axis=1)
    tuples = x[place]
    code = np.full(M, 0x2545F4914F6CDD1D, np.uint64)
    for k in range(n):
        code = tc.mix(code * np.uint64(0x9E3779B97F4A7C15) + tuples[:, k])
    return (code >> np.uint64(48)).astype(">u2").tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Part of the functions that agree; two empty texts are alike."""
    if not a or not b:
        return float(a == b)
    return sum(a[i : i + 4] == b[i : i + 4] for i in range(0, 4 * M, 4)) / M


def fingerprints(texts: list[str]) -> list[str]:
    return [fingerprint(x) for _, _, raw, at in tc.slices(pa.array(texts, pa.large_string())) for x in kmers(raw, at)]


def edited_text(text: str, following: str) -> str:
    """The last third of the code points replaced by the first as many, or all, of the next text."""
    n = len(text) // 3
    return text[: len(text) - n] + following[:n] if n else text


OUT = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows (doc_id, text, guest), descending: each row with the row after it. A guest is only looked at."""
    before: tuple | None = None
    for batch in batches:
        ids, texts, guests = (batch.column(i).to_pylist() for i in (0, 1, 2))
        for first in range(0, len(ids), 200):
            part = slice(first, first + 200)
            rows = list(zip(ids[part], [t or "" for t in texts[part]], guests[part], fingerprints([t or "" for t in texts[part]]), strict=True))
            chain = [before, *rows] if before else rows
            edits = [edited_text(a[1], b[1]) for a, b in zip(chain, chain[1:], strict=False)]
            own = fingerprints(edits)
            out = []
            for a, b, e, f in zip(chain, chain[1:], edits, own, strict=False):
                if not a[2]:
                    out.append((a[0], len(a[1]), hashlib.sha256(e.encode()).hexdigest(), a[3], f, likeness(a[3], f), likeness(a[3], b[3])))
            before = chain[-1]
            yield _batch(out, OUT, _KINDS)
    # the last row of a task is a guest, unless the whole table is one row that follows itself
    if before and not before[2]:
        e = edited_text(before[1], before[1])
        f = fingerprints([e])[0]
        yield _batch([(before[0], len(before[1]), hashlib.sha256(e.encode()).hexdigest(), before[3], f, likeness(before[3], f), 1.0)], OUT, _KINDS)


def _placed(rows: DataFrame, cuts: list[int]) -> DataFrame:
    """rows with the number of their range. Ranges meet rows by coarse cells of equal width, so that a row tries a few ranges, not all."""
    if not cuts:
        return rows.withColumn("part", F.lit(0))
    width = max((cuts[-1] - cuts[0]) / (4 * len(cuts)), 1.0)
    cell = lambda x: min(max(math.floor((float(x) - float(cuts[0])) / width), -1), 4 * len(cuts) + 1)
    ends = [None, *cuts, None]
    table = []
    for i, (lo, hi) in enumerate(zip(ends, ends[1:], strict=False)):
        first, last = -1 if lo is None else cell(lo) - 1, 4 * len(cuts) + 1 if hi is None else cell(hi) + 1
        table += [(c, lo, hi, len(cuts) - i) for c in range(first, last + 1)]
    ranges = F.broadcast(rows.sparkSession.createDataFrame(table, "cell int, lo long, hi long, part int"))
    own = F.floor((F.col("doc_id").cast("double") - F.lit(float(cuts[0]))) / F.lit(width))
    own = F.least(F.greatest(own, F.lit(-1)), F.lit(4 * len(cuts) + 1)).cast("int")
    inside = (F.col("lo").isNull() | (F.col("doc_id") > F.col("lo"))) & (F.col("hi").isNull() | (F.col("doc_id") <= F.col("hi")))
    out = rows.withColumn("own", own).join(ranges, (F.col("own") == F.col("cell")) & inside, "left")
    return out.select(*rows.columns, F.coalesce("part", F.lit(len(cuts) + 1)).alias("part"))


def order_minhash(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The next document is the one with the next smaller id, after the last the first; rows of one id are ordered by
    text, null ids come last. A null text is empty: fingerprint "", edited text empty. A single row follows itself.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = partitions(spark)
    cuts = sorted(set(rows.approxQuantile("doc_id", [i / n for i in range(1, n)], 0.25 / n))) if n > 1 else []
    # range 0 holds the largest ids, the last one the null ids; a row that equals a cut goes to the smaller range
    rows = _placed(rows, sorted({min(max(int(c), -(1 << 63)), (1 << 63) - 1) for c in cuts}))
    order = F.struct(F.col("doc_id").isNotNull().alias("a"), "doc_id", F.xxhash64("text").alias("t"))
    # the largest row of each range, one for each of n + 1 ranges, without its text
    heads = rows.groupBy("part").agg(F.max(order).alias("h")).collect()
    filled = sorted(r["part"] for r in heads)
    above = {p: filled[i - 1] for i, p in enumerate(filled)}
    listed = spark.createDataFrame([(r["part"], r["h"]["doc_id"], r["h"]["t"], above[r["part"]]) for r in heads], "head_part int, head_id long, head_t long, to int")
    # copies of a head row with the same id and text are one guest
    met = (F.col("part") == F.col("head_part")) & F.col("doc_id").eqNullSafe(F.col("head_id")) & (F.xxhash64("text") == F.col("head_t"))
    guests = rows.join(F.broadcast(listed), met).dropDuplicates(["to", "doc_id", "text"])
    total_one = len(filled) == 1 and rows.limit(2).count() == 1
    out = rows.select("part", "doc_id", "text", F.lit(False).alias("guest"))
    if filled and not total_one:
        out = out.unionByName(guests.select(F.col("to").alias("part"), "doc_id", "text", F.lit(True).alias("guest")))
    out = out.repartitionById(len(cuts) + 2, "part").sortWithinPartitions(F.col("guest"), F.col("doc_id").desc_nulls_last(), F.xxhash64("text").desc())
    return out.select("doc_id", "text", "guest").mapInArrow(_pairs, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
