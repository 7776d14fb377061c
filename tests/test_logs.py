"""Rules of log lines one by one, records over batch boundaries, late rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tesselode.operators import logs as L
from tesselode.streaming import windows as W

LINE = "process string, seq long, ts timestamp, line string, text string"
START = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize(
    "text, want",
    [
        ("src/a.go:12:7: undefined: x", {"file": "src/a.go", "line": 12, "column": 7, "severity": "P3", "event_type": "info"}),
        ("a.c:3: error: bad", {"file": "a.c", "line": 3, "column": 0, "exception": "", "severity": "P1", "event_type": "compiler_diagnostic"}),
        ("0x40ff <main+0x1a>", {"address": "0x40ff", "symbol": "main", "offset": "0x1a"}),
        ("#0  f (0x1)\n#1 g\nlast", {"stack": ["f", "g"], "message": "last"}),
        ("panic: boom", {"exception": "boom", "severity": "P0", "event_type": "crash"}),
        ("exit code=-0x7F", {"error_code": "-0x7F", "message": "", "severity": "P3"}),
        ("--- FAIL --- pkg/TestX", {"test_name": "pkg/TestX", "severity": "P1", "event_type": "test_failure"}),
        ("main.run + 0x4c", {"symbol": "main.run", "offset": "0x4c"}),
        ("libc.so!7ffe", {"module": "libc.so", "address": "7ffe"}),
        ("\x1b[31m  Warning  \x1b[0m\r\n\n", {"message": "Warning", "severity": "P2"}),
        ("a.c:1: x\nb.c:2:\nException: E1\nfault: E2", {"file": "b.c", "line": 2, "exception": "E2", "message": "a.c:1: x | b.c:2: | Exception: E1 | fault: E2", "event_type": "exception"}),
        ("a.c:1:5: x\nb.c:2: y", {"line": 2, "column": 5}),
        ("a.c:99999999999999999999: x", {"file": "a.c", "line": 0}),
        ("", {"file": "", "message": "", "stack": [], "severity": "P3", "event_type": "info"}),
        (None, {"message": ""}),
    ],
)
def test_rules(spark, text, want):
    got = L.parse(spark.createDataFrame([(text, "clash", 1)], "text string, file string, severity int")).first().asDict()
    assert {k: got[k] for k in want} == want


def feed(spark):
    rows, seq = [], 0
    for p, parts in (("a", ["one", "two", "", "three", None, "four"]), ("b", ["#0 f", "#1 g", "#2 h", "", "", "x", "y", ""])):
        for line in parts:
            seq += 1
            rows.append((p, seq, START + dt.timedelta(seconds=seq), line, "x"))
    rows += [("a", 90, START + dt.timedelta(seconds=300), "after a pause", "x"), ("a", 91, START + dt.timedelta(seconds=301), "", "x"), ("c", 92, START + dt.timedelta(seconds=400), "late end", "x"), ("d", 95, START + dt.timedelta(seconds=9000), "", "x")]
    rows += [("long", 100 + i, START + dt.timedelta(seconds=9000), f"l{i}", "x") for i in range(7)] + [("long", 120, START + dt.timedelta(seconds=9001), "", "x")]
    return spark.createDataFrame([*rows, (None, 1, START, "x", "x"), ("a", None, START, "x", "x"), ("a", 1, None, "x", "x")], LINE)


def test_batch_is_stream(spark):
    rows = feed(spark)
    batch = {tuple(r) for r in L.assemble(rows, 30, 3).collect()}
    assert batch == {("a", 1, 2, "one\ntwo"), ("a", 4, 1, "three"), ("a", 6, 1, "four"), ("b", 7, 3, "#0 f\n#1 g\n#2 h"), ("b", 12, 2, "x\ny"), ("a", 90, 1, "after a pause"), ("c", 92, 1, "late end"), ("long", 100, 3, "l0\nl1\nl2"), ("long", 103, 3, "l3\nl4\nl5"), ("long", 106, 1, "l6")}
    for slices in (1, 5, 40):
        clean = rows.where("seq IS NOT NULL")
        stream = L.assemble_stream(W.sliced(spark, clean, "seq", slices), 30, 3)
        got = [tuple(r) for r in W.drain(stream, "append").collect()]
        assert len(got) == len(set(got)) and set(got) == batch, slices
    assert L.assemble(rows.where("false")).count() == 0 and W.drain(L.assemble_stream(W.sliced(spark, rows.where("false"), "seq", 2)), "append").count() == 0


def test_rows_that_are_too_late(spark):
    at = lambda h: START + dt.timedelta(hours=h)
    rows = [(1, at(1), "e"), (2, at(50), "e"), (3, at(51), "e"), (4, at(2), "e"), (5, at(49), "e"), (6, at(200), "e"), (7, at(3), "e")]
    events = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string")
    got = {(str(r["window_start"]), r["n"]) for r in W.drain(W.late_tumbling(W.sliced(spark, events, "event_id", 7)), "append").collect()}
    # rows 4 and 7 come when their day is closed; the last day is still open
    assert got == {("2024-01-01 00:00:00", 1), ("2024-01-03 00:00:00", 3)}
    assert W.late_tumbling(events).agg(F.sum("n")).first()[0] == 7
