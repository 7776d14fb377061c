"""Fill-in-the-middle rewriting of whole texts, and the way back.

One automaton over bytes, given as a table, knows where units begin (UTF-8 continuation bytes, line
ends) and where a sentinel ends. Its state never depends on more than the last three bytes, so the
table is unrolled into one that is looked up with four byte classes at a time: a slice of many
documents is scanned in one vectorised pass, whose emissions are counted by document. A second pass
turns the counts at which a document is cut into byte offsets.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .runtime import tune

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Classes of bytes.
OTHER, OPEN, LETTER, CLOSE, NEWLINE, TAIL, LEAD2, LEAD3, LEAD4 = range(9)
#: States: in a unit's end, at the start of a line, behind `<`, behind `<` and a letter, 1 to 3 continuation bytes due.
PLAIN, START, OPENED, NAMED, DUE1, DUE2, DUE3 = range(7)
#: Emissions: a code point begins, a line begins, a sentinel ends.
CHAR, LINE, MARK = 1, 2, 4
UNITS = {"char": CHAR, "line": LINE}
_BACK = 3


def _classes() -> np.ndarray:
    out = np.full(256, OTHER, np.uint8)
    out[[ord("<"), ord(">"), ord("\n")]] = OPEN, CLOSE, NEWLINE
    out[list(b"PSM")] = LETTER
    out[0x80:0xC0], out[0xC0:0xE0], out[0xE0:0xF0], out[0xF0:] = TAIL, LEAD2, LEAD3, LEAD4
    return out


def step(state: int, kind: int) -> tuple[int, int]:
    """The automaton: next state and emission. A continuation byte that none was due for is a unit of its own."""
    if kind == TAIL and state >= DUE1:
        return (PLAIN if state == DUE1 else state - 1), 0
    emits = CHAR | (LINE if state == START else 0) | (MARK if state == NAMED and kind == CLOSE else 0)
    to = {OPEN: OPENED, LETTER: NAMED if state == OPENED else PLAIN, NEWLINE: START, LEAD2: DUE1, LEAD3: DUE2, LEAD4: DUE3}
    return to.get(kind, PLAIN), emits


def _unrolled() -> np.ndarray:
    """Emission of a byte by its class and those of the three before it."""
    out = np.zeros((9,) * (_BACK + 1), np.uint8)
    for before in itertools.product(range(9), repeat=_BACK):
        ends = set()
        for state in range(7):
            for kind in before:
                state = step(state, kind)[0]
            ends.add(state)
        if len(ends) != 1:
            raise AssertionError(f"the state depends on more than {_BACK} bytes: {before}")
        (state,) = ends
        out[before] = [step(state, kind)[1] for kind in range(9)]
    return out


_CLASS, _EMIT = _classes(), _unrolled().ravel()


def scan(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Emission of each byte of a slice; each document begins at the start of a line."""
    kind = _CLASS[raw].astype(np.int16)
    index = kind.copy()
    for j in range(1, _BACK + 1):
        index[j:] += kind[:-j] * np.int16(9**j)
    for j in range(_BACK):  # the first bytes of a document see line ends before it, not the document before
        i = at[:-1][np.diff(at) > j] + j
        index[i] = sum(kind[i - k] * 9**k for k in range(j + 1)) + sum(NEWLINE * 9**k for k in range(j + 1, _BACK + 1))
    return _EMIT[index]


def _binary(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"").view(pa.large_string())


_OUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_units", pa.int64()), ("middle_units", pa.int64()), ("output", pa.binary())])


def _rewrite(unit: int, rate: int, spm: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            draws = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False) for i in range(2, 6)]) if batch.num_rows else np.zeros((0, 4), np.int64)
            for first, last, raw, at in tc.slices(_binary(batch.column(1))):
                emits = scan(raw, at)
                units, marks = np.flatnonzero(emits & unit), np.flatnonzero(emits & MARK)
                base, marked = np.searchsorted(units, at), np.searchsorted(marks, at)
                n, h = np.diff(base), draws[first:last]
                low, high = np.sort(np.column_stack((h[:, 0] % (n + 1), h[:, 1] % (n + 1))), axis=1).T
                plain = (n == 0) | (np.diff(marked) > 0) | (h[:, 2] % 100 >= rate)
                ends = np.append(units, 0)
                # a cut before unit k of n; behind the last unit lies the document's end
                cut = [np.where(k < n, ends[np.minimum(base[:-1] + k, len(units))], at[1:]) for k in (low, high)]
                data, form, out = raw.tobytes(), np.where(plain, "plain", np.where(h[:, 3] % 100 < spm, "spm", "psm")), []
                for f, a, b, c, d in zip(form.tolist(), at[:-1].tolist(), cut[0].tolist(), cut[1].tolist(), at[1:].tolist(), strict=True):
                    if f == "plain":
                        out.append(data[a:d])
                    elif f == "psm":
                        out.append(b"".join((PREFIX, data[a:b], SUFFIX, data[c:d], MIDDLE, data[b:c])))
                    else:
                        out.append(b"".join((SUFFIX, data[c:d], PREFIX, data[a:b], MIDDLE, data[b:c])))
                cols = [ids.slice(first, last - first), pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(low, mask=plain), pa.array(high - low, mask=plain), pa.array(out, pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=_OUT)

    return run


def fill_in_middle(docs: DataFrame, unit: str = "char", rate: int = 90, spm: int = 20, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n, form, prefix_units, middle_units, output for every row of docs.

    n: units of the text, code points (`char`) or lines (`line`). form: plain, psm or spm. A text is plain if it is
    empty or null, holds a sentinel, or its draw says so (100 - rate of 100); of the others spm of 100 are
    suffix first. Cuts and draws come from sha256 of `seed:id`, so that repeated rows come out alike; a null id
    is drawn for as an empty one. prefix_units and middle_units are null if plain. Only the id and the text are read.
    """
    tune(docs.sparkSession)
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    draw: list[Column] = [F.conv(F.substring(key, 8 * i + 1, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"), *draw)
    out = rows.mapInArrow(_rewrite(UNITS[unit], rate, spm), "doc_id long, n long, form string, prefix_units long, middle_units long, output binary")
    return out.withColumn("output", F.col("output").cast("string"))


def _restored(form: str, data: bytes, ends: list[int]) -> bytes:
    if form == "plain":
        return data
    if len(ends) != 3:
        raise ValueError(f"a rewritten text has {len(ends)} sentinels")
    one, two, middle = data[ends[0] + 1 : ends[1] - 2], data[ends[1] + 1 : ends[2] - 2], data[ends[2] + 1 :]
    return one + middle + two if form == "psm" else two + middle + one


def _restore(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        forms, out = batch.column("form").to_pylist(), []
        for first, last, raw, at in tc.slices(_binary(batch.column("output"))):
            marks, data = np.flatnonzero(scan(raw, at) & MARK), raw.tobytes()
            of = np.searchsorted(marks, at)
            for i in range(last - first):
                a, b = int(at[i]), int(at[i + 1])
                out.append(_restored(forms[first + i], data[a:b], (marks[of[i] : of[i + 1]] - a).tolist()))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], names=[*batch.schema.names, "restored"])


def restore(rows: DataFrame) -> DataFrame:
    """Rows of fill_in_middle with the text that output and form alone give back, in `restored`."""
    tune(rows.sparkSession)
    rows = rows.withColumn("output", F.col("output").cast("binary"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    out = rows.mapInArrow(_restore, f"{kinds}, restored binary")
    return out.withColumns({c: F.col(c).cast("string") for c in ("output", "restored")})
