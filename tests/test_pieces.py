"""Batches taken in small pieces: no row is lost, and what a task makes at once is bounded."""

import pyarrow as pa

from tesselode.operators import privacy as P
from tesselode.operators import security as S
from tesselode.sources import files as X
from tesselode.sources import tables as T


def test_pieces_hold_all_rows_in_order():
    texts = [None, "", "x" * (3 << 20), *["y" * 50_000] * 200]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["i", "t"])
    got = list(T.pieces(iter([batch, batch.slice(0, 0)])))
    assert all(b.nbytes <= T.PIECE_BYTES or b.num_rows == 1 for b in got) and len(got) > 5
    assert [i for b in got for i in b.column(0).to_pylist()] == list(range(len(texts)))


def test_findings_and_names_take_texts_in_pieces(spark, monkeypatch):
    tasks, kind = [], type(spark.range(0))
    own = kind.mapInArrow
    monkeypatch.setattr(kind, "mapInArrow", lambda df, task, schema: tasks.append(task) or own(df, task, schema))
    long = "z" * 20_000
    S.findings(spark.createDataFrame([("a", "c", "x")], "path string, language string, content string"))
    batch = pa.RecordBatch.from_arrays([pa.array([str(i) for i in range(500)]), pa.array(["c"] * 500), pa.array([long + " gets(a)"] * 500)], ["path", "language", "content"])
    got = list(tasks[0](iter([batch])))
    assert len(got) > 3 and [p for b in got for p in b.column(0).to_pylist()] == [str(i) for i in range(500)]
    texts = spark.createDataFrame([(i, f"{long} abc{i}") for i in range(50)], "id long, text string")
    out = P.replaced(texts, spark.createDataFrame([("abc", "N_1")], "name string, token string"))
    assert {r["id"]: r["text"][20_001:] for r in out.collect()} == {i: f"N_1{i}" for i in range(50)}
    whole = [f"{long} abc{i}" for i in range(500)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(whole), pa.array([[t] for t in whole], pa.list_(pa.string()))], ["id", "text", "_id_text"])
    got = list(tasks[1](iter([batch])))
    assert len(got) > 3 and ["".join(p) for b in got for p in b.column(2).to_pylist()] == [f"{long} N_1{i}" for i in range(500)]


def test_symbols_leave_file_by_file():
    code = "\n".join(f"def f{i}(a):\n    return g(a)" for i in range(2500))
    batch = pa.RecordBatch.from_arrays([pa.array(["a.py", "bad.py", "b.py", "n.py"]), pa.array([code, "def (", code, None])], ["path", "content"])
    got = list(X._python(iter([batch])))
    assert [b.num_rows for b in got] == [1000, 1000, 500] * 2
    assert got[0].column(2).to_pylist()[:2] == ["f0", "f1"] and set(got[3].column(0).to_pylist()) == {"b.py"}
