"""Exact repeated windows in a corpus, without a row for each position.

Documents are sequences of tokens (bytes or words). Two documents share a window of
W tokens only if they share the window's anchor: the k tokens with the smallest
hash in it, the leftmost of equals. Consecutive windows with one anchor form a
phrase, and equal windows lie at equal places of their anchors. So

1. each phrase is a record (hash of the anchor, hash of the phrase, document, start), and
   one exchange by anchor brings equal anchors together. Sorted by anchor, then by phrase,
   all but the first of equal phrases are repeats, window by window.
2. Where an anchor stands in different phrases, windows may still be equal in part: at the
   ends of copied runs. With step > 1 these phrases are cut by the windows' distance to the
   anchor into groups of `step` windows, which are records again: (hash of what all windows of the
   group hold, hash of the whole group). Only groups that agree in the first and not in the second go on.
3. The windows left are compared one by one, by two digits of W/2 tokens each.

Records travel as numpy blobs, byte planes apart, as ids and places then compress. Before an exchange each task keeps only the first of
equal records, as the others are repeats whatever the other tasks hold; so a passage
that a third of all documents share costs one record for each task. An anchor met in many
phrases within one task is dealt out by phrase and always goes to step 2, which is exact
for whatever reaches it; one marker tells the anchor's own partition so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .runtime import fresh, materialise, partitions, tune

#: a, b: the two digits; doc, tx: document id and hash of its text; lo, n: first window and count.
RECORD = np.dtype([("a", "<u8"), ("b", "<u8"), ("doc", "<i8"), ("tx", "<i4"), ("lo", "<u4"), ("n", "<u2")])
#: A phrase count for an anchor, within a task, from which its records are dealt out by phrase.
CROWD = 8
#: Records a task holds before it passes them on.
FLUSH = 1_500_000
MARK = 0xFFFF


@dataclass(frozen=True)
class Units:
    """How a text is cut into tokens: W and k in tokens; strict: only documents with a smaller id are earlier."""

    kind: str
    window: int
    anchor: int
    strict: bool
    step: int = 1

    def __post_init__(self) -> None:
        if not 1 <= self.window < MARK:
            raise ValueError(f"a window holds 1 to {MARK - 1} tokens, not {self.window}")

    def tokens(self, raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.kind == "bytes":
            return tc.BYTE_VALUES[raw], at
        start, end, of = tc.word_bounds(raw, at)
        return tc.word_hashes(raw, start, end), of


def phrases(tok: np.ndarray, of: np.ndarray, unit: Units, whole: bool = False) -> dict[str, np.ndarray] | None:
    """Runs of windows with one anchor: first window, count, hashes of the anchor and the phrase (or, if whole, the anchor's place)."""
    n, w, k = len(tok), unit.window, unit.anchor
    if n < w:
        return None
    sums = tc.prefix(tok)
    down = tc.powers(n + 1)[1]
    gram = tc.mix((sums[k:] - sums[:-k]) * down[: n - k + 1])
    key = (gram & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(gram), dtype=np.uint64)
    anchor = (tc.sliding_min(key, w - k + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ends = np.repeat(of[1:], np.diff(of))[: n - w + 1]
    p = np.flatnonzero(np.arange(w, n + 1) <= ends)
    if not len(p):
        return None
    a = anchor[p]
    fresh = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (p[1:] != p[:-1] + 1))))
    lo, hi = p[fresh], p[np.append(fresh[1:], len(p)) - 1]
    a = a[fresh]
    if whole:
        return {"lo": lo, "n": hi - lo + 1, "at": a}
    shape = ((a - lo).astype(np.uint64) << np.uint64(32)) | (hi - lo).astype(np.uint64)
    return {"lo": lo, "n": hi - lo + 1, "a": gram[a], "b": tc.span(sums, lo, hi + w) ^ tc.mix(shape)}


def first_of_equals(r: np.ndarray, strict: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """r sorted by (a, b, doc, lo), the indices where groups of equal (a, b) begin, and which records are repeats."""
    r = r[np.lexsort((r["lo"], r["doc"], r["b"], r["a"]))]
    new = np.concatenate(([True], (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])))
    start = np.flatnonzero(new)
    least = np.repeat(r["doc"][start], np.diff(np.append(start, len(r))))
    if strict:
        again = r["doc"] > least
    else:
        lo = np.repeat(r["lo"][start], np.diff(np.append(start, len(r))))
        again = (r["doc"] > least) | (r["lo"] > lo)
    return r, start, again


def _batch(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kinds[i]) for i in range(len(names))], names)


def _planes(r: np.ndarray) -> bytes:
    return np.ascontiguousarray(r).view(np.uint8).reshape(len(r), RECORD.itemsize).T.tobytes()


def _records(blobs: list[bytes]) -> np.ndarray:
    parts = [np.frombuffer(b, np.uint8).reshape(RECORD.itemsize, -1).T for b in blobs]
    return np.ascontiguousarray(np.concatenate(parts)).view(RECORD).ravel() if parts else np.zeros(0, RECORD)


def _dealt(r: np.ndarray, part: np.ndarray, kind: int) -> list[tuple]:
    """(partition, kind, blob) rows of records, by partition."""
    order = np.argsort(part, kind="stable")
    r, part = r[order], part[order]
    cut = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(r) else []
    return [(int(part[i]), kind, _planes(r[i:j])) for i, j in zip(cut, np.append(cut[1:], len(r)), strict=True)] if len(r) else []


def _send(r: np.ndarray, n_parts: int, unit: Units, crowd: bool) -> Iterator[pa.RecordBatch]:
    """What a task passes on of its records: the first of equals by its digits, repeats to their documents."""
    if not len(r):
        return
    r, start, again = first_of_equals(r, unit.strict)
    modulus = np.uint64(n_parts)
    rows = _dealt(r[again], (tc.mix(r["doc"][again].astype(np.uint64)) % modulus).astype(np.int64), 1)
    r = r[~again]
    if crowd:
        a_new = np.flatnonzero(np.concatenate(([True], r["a"][1:] != r["a"][:-1])))
        b_new = np.concatenate(([True], (r["a"][1:] != r["a"][:-1]) | (r["b"][1:] != r["b"][:-1])))
        many = np.add.reduceat(b_new.astype(np.int64), a_new) >= CROWD
        wide = np.repeat(many, np.diff(np.append(a_new, len(r))))
        marks = np.zeros(int(many.sum()), RECORD)
        marks["a"], marks["n"] = r["a"][a_new[many]], MARK
        rows += _dealt(r[wide], (tc.mix(r["a"][wide] ^ tc.mix(r["b"][wide])) % modulus).astype(np.int64), 2)
        r = np.concatenate((r[~wide], marks))
    rows += _dealt(r, (tc.mix(r["a"].copy()) % modulus).astype(np.int64), 0)
    for i in range(0, len(rows), 2000):
        yield _batch(rows[i : i + 2000], ["part", "kind", "blob"], [pa.int32(), pa.int32(), pa.binary()])


def _spread(unit: Units, n_parts: int, restricted: bool) -> Callable:
    """Task over (doc_id, tx, text[, open]): phrases of whole texts, or the windows listed in open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            tx = batch.column(1).to_numpy(zero_copy_only=False)
            for first, last, raw, at in tc.slices(batch.column(2)):
                tok, of = unit.tokens(raw, at)
                if restricted:
                    part = _windows(tok, of, unit, batch.column(3)[first:last])
                else:
                    part = phrases(tok, of, unit)
                if part is None:
                    continue
                at_doc = np.searchsorted(of, part["lo"], "right") - 1
                r = np.empty(len(at_doc), RECORD)
                r["a"], r["b"], r["n"] = part["a"], part["b"], part["n"]
                r["doc"], r["tx"], r["lo"] = ids[first:last][at_doc], tx[first:last][at_doc], part["lo"] - of[at_doc]
                held.append(r)
            if sum(map(len, held)) >= FLUSH:
                yield from _send(np.concatenate(held), n_parts, unit, not restricted)
                held = []
        if held:
            yield from _send(np.concatenate(held), n_parts, unit, not restricted)

    return run


def _windows(tok: np.ndarray, of: np.ndarray, unit: Units, listed: pa.Array) -> dict[str, np.ndarray] | None:
    """The listed windows one by one, as two digits of half a window each."""
    starts = []
    for i, blob in enumerate(listed.to_pylist()):
        x = np.frombuffer(b"".join(blob), "<u4").reshape(-1, 2).astype(np.int64)
        starts.append(of[i] + np.repeat(x[:, 0], x[:, 1]) + np.arange(x[:, 1].sum()) - np.repeat(np.cumsum(x[:, 1]) - x[:, 1], x[:, 1]))
    p = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    if not len(p):
        return None
    sums, half = tc.prefix(tok), unit.window // 2
    return {"lo": p, "n": np.ones(len(p), np.int64), "a": tc.span(sums, p, p + half), "b": tc.span(sums, p + half, p + unit.window)}


SNIPPET = "doc_id long, tx int, at long, snippet binary"


def _snippets(unit: Units):
    """Task over (doc_id, tx, text, open): the stretches of text that the open phrases and their groups span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            rows = []
            for doc, tx, text, blobs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = text.encode()
                x = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
                x = x[np.argsort(x[:, 0], kind="stable")]
                lo = np.maximum(x[:, 0] - unit.step + 1, 0)
                hi = np.minimum(np.maximum.accumulate(x.sum(axis=1)) + unit.window + unit.step - 2, len(raw))
                new = np.flatnonzero(np.concatenate(([True], lo[1:] > hi[:-1])))
                rows += [(doc, tx, int(lo[i]), raw[lo[i] : hi[j - 1]]) for i, j in zip(new, np.append(new[1:], len(x)), strict=True)]
            yield _batch(rows, ["doc_id", "tx", "at", "snippet"], kinds)

    return run


def _joined(columns: list) -> tuple[np.ndarray, np.ndarray]:
    data = columns.to_pylist()
    return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])


def _grouped(unit: Units, n_parts: int):
    """Task over snippets: the groups of `step` windows at equal distances from their anchors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        w, step = unit.window, unit.step
        for batch in batches:
            raw, of = _joined(batch.column(3))
            tok = tc.BYTE_VALUES[raw]
            part = phrases(tok, of, unit, True)
            if part is None:
                continue
            lo, anchor = part["lo"], part["at"]
            hi = lo + part["n"] - 1
            first, last = (anchor - hi) // step, (anchor - lo) // step
            many = last - first + 1
            k = np.repeat(np.arange(len(lo)), many)
            j = first[k] + np.arange(len(k)) - np.repeat(np.cumsum(many) - many, many)
            piece = np.searchsorted(of, lo[k], "right") - 1
            near, far = anchor[k] - step * j, anchor[k] - step * j - step + 1  # the window nearest to the anchor, the farthest
            start, end = np.maximum(far, of[piece]), np.minimum(near + w, of[piece + 1])
            sums = tc.prefix(tok)
            r = np.empty(len(k), RECORD)
            # the distance tells apart groups of two anchors that span the same text
            r["a"] = tc.span(sums, near, far + w) ^ tc.mix(j.astype(np.uint64) + np.uint64(1))
            r["b"] = tc.span(sums, start, end) ^ tc.mix((start - far).astype(np.uint64) * np.uint64(1 << 40) + j.astype(np.uint64) * np.uint64(1 << 20) + (near + w - end).astype(np.uint64) + np.uint64(1))
            from_, to = np.maximum(far, lo[k]), np.minimum(near, hi[k])
            r["lo"], r["n"] = from_ - of[piece] + batch.column(2).to_numpy()[piece], to - from_ + 1
            r["doc"], r["tx"] = batch.column(0).to_numpy()[piece], batch.column(1).to_numpy()[piece]
            held.append(r)
            if sum(map(len, held)) >= FLUSH:
                yield from _send(np.concatenate(held), n_parts, unit, True)
                held = []
        if held:
            yield from _send(np.concatenate(held), n_parts, unit, True)

    return run


def _single(unit: Units, n_parts: int):
    """Task over (doc_id, tx, at, snippet, open): the open windows one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            raw, of = _joined(batch.column(3))
            listed, size = [], np.diff(of)
            at = batch.column(2).to_numpy()
            for i, blobs in enumerate(batch.column(4).to_pylist()):
                x = np.frombuffer(b"".join(blobs), "<u4").reshape(-1, 2).astype(np.int64)
                x = x[(x[:, 0] >= at[i]) & (x[:, 0] + x[:, 1] - 1 + unit.window <= at[i] + size[i])] - [at[i], 0]
                listed.append([x.astype("<u4").tobytes()])
            part = _windows(tc.BYTE_VALUES[raw], of, unit, pa.array(listed, pa.list_(pa.binary())))
            if part is None:
                continue
            piece = np.searchsorted(of, part["lo"], "right") - 1
            r = np.empty(len(piece), RECORD)
            r["a"], r["b"], r["n"] = part["a"], part["b"], part["n"]
            r["doc"], r["tx"], r["lo"] = batch.column(0).to_numpy()[piece], batch.column(1).to_numpy()[piece], part["lo"] - of[piece] + at[piece]
            held.append(r)
        if held:
            yield from _send(np.concatenate(held), n_parts, unit, False)

    return run


def _listed(r: np.ndarray) -> np.ndarray:
    """Records as (lo, n) pairs, neighbours joined."""
    lo, n = r["lo"].astype(np.int64), r["n"].astype(np.int64)
    new = np.concatenate(([True], lo[1:] != lo[:-1] + n[:-1]))
    at = np.flatnonzero(new)
    return np.column_stack((lo[at], np.add.reduceat(n, at))).astype("<u4")


def _by_document(done: np.ndarray, open_: np.ndarray) -> Iterator[pa.RecordBatch]:
    names, kinds = ["doc_id", "tx", "done", "open"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    rows = []
    for r, where in ((done, 2), (open_, 3)):
        if not len(r):
            continue
        r = r[np.lexsort((r["lo"], r["tx"], r["doc"]))]
        cut = np.flatnonzero(np.concatenate(([True], (r["doc"][1:] != r["doc"][:-1]) | (r["tx"][1:] != r["tx"][:-1]))))
        for i, j in zip(cut, np.append(cut[1:], len(r)), strict=True):
            row = [int(r["doc"][i]), int(r["tx"][i]), None, None]
            row[where] = _listed(r[i:j]).tobytes()
            rows.append(row)
    for i in range(0, len(rows), 5000):
        yield _batch(rows[i : i + 5000], names, kinds)


def _gather(unit: Units, last: bool) -> Callable:
    """Task over the blobs of a partition: which records are repeats, and which are open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {0: [], 1: [], 2: []}
        for batch in batches:
            for kind, blob in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[kind].append(blob)
        records = {k: _records(v) for k, v in held.items()}
        held.clear()
        done, open_ = [records[1]], []
        for kind in (0, 2):
            r = records.pop(kind)
            if not len(r):
                continue
            marked = r["a"][r["n"] == MARK]
            r = r[r["n"] != MARK]
            if not len(r):
                continue
            r, start, again = first_of_equals(r, unit.strict)
            done.append(r[again])
            if not last:
                begin = np.flatnonzero(np.concatenate(([True], r["a"][1:] != r["a"][:-1])))
                several = np.add.reduceat(np.isin(np.arange(len(r)), start).astype(np.int64), begin) > 1
                several |= np.isin(r["a"][begin], marked) | (kind == 2)
                open_.append(r[np.repeat(several, np.diff(np.append(begin, len(r)))) & ~again])
        yield from _by_document(np.concatenate(done), np.concatenate(open_) if open_ else np.zeros(0, RECORD))

    return run


def repeated_windows(docs: DataFrame, unit: Units) -> DataFrame:
    """Lists of repeated windows of docs(doc_id, tx, text): doc_id, tx, done array of (first, count) blobs.

    Ids must not be null. Rows that repeat both id and text are one document.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows, found = "part int, kind int, blob binary", "doc_id long, tx int, done binary, open binary"
    one = docs.mapInArrow(_spread(unit, n, False), rows)
    one = materialise(one.repartitionById(n, "part").mapInArrow(_gather(unit, False), found))
    left = one.where("open is not null").groupBy("doc_id", "tx").agg(F.collect_list("open").alias("open"))
    opened = docs.join(left, ["doc_id", "tx"]).select("doc_id", "tx", "text", "open")
    levels = [one]
    if unit.step > 1:
        snippets = materialise(opened.mapInArrow(_snippets(unit), SNIPPET))
        two = materialise(snippets.mapInArrow(_grouped(unit, n), rows).repartitionById(n, "part").mapInArrow(_gather(unit, False), found))
        left = two.where("open is not null").groupBy("doc_id", "tx").agg(F.collect_list("open").alias("open"))
        levels.append(two)
        singles = snippets.join(left, ["doc_id", "tx"]).select("doc_id", "tx", "at", "snippet", "open").mapInArrow(_single(unit, n), rows)
    else:
        singles = opened.mapInArrow(_spread(unit, n, True), rows)
    levels.append(singles.repartitionById(n, "part").mapInArrow(_gather(unit, True), found))
    done = [x.where("done is not null").select("doc_id", "tx", "done") for x in levels]
    return reduce(DataFrame.unionByName, done).groupBy("doc_id", "tx").agg(F.collect_list("done").alias("done"))


def removed_mask(lists: list[bytes] | None, n: int, window: int) -> np.ndarray:
    """Which of n tokens the listed windows cover."""
    steps = np.zeros(n + 1, np.int64)
    if lists:
        x = np.frombuffer(b"".join(lists), "<u4").reshape(-1, 2).astype(np.int64)
        np.add.at(steps, x[:, 0], 1)
        np.add.at(steps, x[:, 0] + x[:, 1] - 1 + window, -1)
    return np.cumsum(steps[:-1]) > 0


ADDED = ["n_tokens", "n_removed", "n_spans", "kept_sha256"]


def remove_repeats(docs: DataFrame, unit: Units, id_col: str, text_col: str, keep_text: bool) -> DataFrame:
    """docs with n_tokens, n_removed, n_spans, kept_sha256 and, if asked for, the text that is left.

    Every row stays. A null text is empty; a row with a null id is neither a source nor cut. Columns of docs that have
    the name of an added one are replaced; all others pass through, whatever their names.
    """
    tune(docs.sparkSession)
    docs = docs.drop(*ADDED)
    tx, found, found_tx, listed = (fresh(docs, x) for x in ("tx", "found", "found_tx", "done"))
    own = docs.withColumn(tx, F.hash(F.col(text_col)))
    keyed = own.where(F.col(id_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(tx).alias("tx"), F.col(text_col).alias("text"))
    lists = repeated_windows(keyed, unit).select(F.col("doc_id").alias(found), F.col("tx").alias(found_tx), F.col("done").alias(listed))
    joined = own.join(lists, (F.col(id_col) == F.col(found)) & (F.col(tx) == F.col(found_tx)), "left").drop(found, found_tx, tx)
    base = [c for c in docs.columns if keep_text or c != text_col]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in base] + ["n_tokens long", "n_removed long", "n_spans long", "kept_sha256 string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(listed)
            texts = batch.column(text_col)
            out: list[tuple] = []
            for first, last, raw, at in tc.slices(texts):
                start, end, of = (None, None, at) if unit.kind == "bytes" else tc.word_bounds(raw, at)
                for i in range(last - first):
                    done, lo, hi = lists[first + i].as_py(), of[i], of[i + 1]
                    text = raw[at[i] : at[i + 1]]
                    gone = removed_mask(done, hi - lo, unit.window) if done else None
                    if unit.kind == "bytes":
                        left = text.tobytes() if gone is None else text[~gone].tobytes()
                    elif gone is None:
                        left = b" ".join(text.tobytes().split())
                    else:
                        kept = np.flatnonzero(~gone) + lo
                        left = b" ".join([raw[s:e].tobytes() for s, e in zip(start[kept], end[kept], strict=True)])
                    spans = 0 if gone is None or not len(gone) else int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    removed = 0 if gone is None else int(gone.sum())
                    original = text.tobytes() if keep_text and not removed else left
                    out.append((int(hi - lo), removed, spans, hashlib.sha256(left).hexdigest(), original.decode("utf-8", "ignore") if keep_text else None))
            cols = {c: batch.column(c) for c in base}
            if keep_text:
                cols[text_col] = pa.array([None if t is None else x[4] for t, x in zip(texts.to_pylist(), out, strict=True)], pa.string())
            for i, name in enumerate(ADDED[:3]):
                cols[name] = pa.array([x[i] for x in out], pa.int64())
            cols[ADDED[3]] = pa.array([x[3] for x in out], pa.string())
            yield pa.RecordBatch.from_pydict(cols)

    return joined.mapInArrow(run, schema)
