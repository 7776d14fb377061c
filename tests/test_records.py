"""Writers, the store and resolvers on small odd rows."""

import random

import pytest
from pyspark.sql import functions as F

from tesselode.operators import graph as G
from tesselode.operators import records as R
from tesselode.operators import resolve as V
from tesselode.operators import store as S


def test_state_is_the_merge_of_writes(spark):
    log = spark.createDataFrame([(1, "F", "a", {"x": "1", "y": "1"}), (3, "F", "a", {"x": "3"}), (2, "F", "a", {"x": "2", "z": None}), (1, "F", "b", {}), (1, "F", "c", None), (1, "G", "a", {"x": "g"})], "seq long, kind string, id string, props map<string,string>")
    got = {(r["kind"], r["id"]): r["t"] for r in S.merged(log).select("kind", "id", S.props_text(F.col("props")).alias("t")).collect()}
    assert got == {("F", "a"): "x=3;y=1", ("F", "b"): "", ("F", "c"): "", ("G", "a"): "x=g"}
    assert S.merged(log.where("false")).count() == 0
    row = {r["id"]: r["row"] for r in S.present(S.merged(log).where("kind = 'F'")).collect()}
    assert row["a"] == {"id": "a", "kind": "F", "x": "3", "y": "1"} and row["b"] == {"id": "b", "kind": "F"}


def test_links_and_removal(spark):
    edges = spark.createDataFrame([("e2", "C", "a", "b", {"w": "1"}), ("e1", "C", "a", "b", {"w": "1"}), ("e3", "C", "a", "b", None), ("e4", "C", "b", "b", {})], "id string, kind string, from_id string, to_id string, props map<string,string>")
    assert sorted(r["id"] for r in S.linked(edges).collect()) == ["e1", "e3", "e4"]
    nodes = spark.createDataFrame([("a",), ("b",)], "id string")
    left, kept = S.without_nodes(nodes, edges, spark.createDataFrame([("b",), ("zz",)], "id string"))
    assert [r["id"] for r in left.collect()] == ["a"] and kept.count() == 0
    assert S.without_edges(edges, spark.createDataFrame([("e1",)], "id string")).count() == 3


def test_records_are_checked(spark):
    rows = spark.createDataFrame([(1, "p", "s", "d", 0.5), (2, "p", "s", "d", 1.5), (3, None, "s", "d", 0.5), (None, "p", "s", "d", 0.5), (5, "p", None, "d", None)], "seq long, project_id string, subject_id string, description string, confidence double")
    log, edges, bad = R.record("record_evidence", rows)
    assert sorted((str(r["seq"]), r["why"]) for r in bad.collect()) == [("2", "confidence"), ("3", "project_id"), ("None", "seq")]
    assert log.count() == 2 and [r["from_id"] for r in edges.collect()] == ["s"]
    props = log.where("seq = 1").first()["props"]
    assert props["state"] == "OBSERVATION" and props["source"] == "manual" and "agent" not in props
    members = spark.createDataFrame([(1, "p", "t", "a", "tech_lead", 7), (2, "p", "t", "b", "king", 7), (3, "p", "t", "c", None, 7)], "seq long, project_id string, team_id string, agent string, role string, why int")
    _, edges, bad = R.record("team_member", members)
    assert [r["to_id"] for r in edges.collect()] == ["a"] and {r["why"] for r in bad.collect()} == {"role"}
    for op in R.RECORDS:
        assert R.record(op, rows.where("false"))[0].count() == 0


def test_state_of_records_is_the_merge_of_their_log(spark):
    texts = sorted({c for x in R.RECORDS.values() for c in (*x.identity, *x.state, *[c for k in x.links for c in (k.source, k.target, *k.props.values()) if c])} - {"confidence", "role"})
    pick = random.Random(3)
    rows = [(pick.choice([None, *range(40)]), pick.choice([None, 0.5, 0.25, 2.0]), pick.choice([*R.ROLES[:2], "king", None]), *[pick.choice([None, "", "x", "1:y"]) if c not in ("project_id", "team_id", "title") else pick.choice("pq") for c in texts]) for _ in range(300)]
    rows = spark.createDataFrame(rows, "seq long, confidence double, role string, " + ", ".join(f"{c} string" for c in texts)).cache()
    flat = lambda df: sorted(str([sorted(x.items()) if isinstance(x, dict) else x for x in r]) for r in df.collect())
    for op in R.RECORDS:
        log, edges, bad = R.record(op, rows)
        nodes, links, refused = R.state(op, rows)
        assert flat(nodes) == flat(S.merged(log).select("kind", "id", "props")) and flat(links) == flat(S.linked(edges)) and flat(refused) == flat(bad)
        # a node takes one exchange of its identity and values, no rows of single properties
        plan = nodes._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange hashpartitioning") == (1 if R.RECORDS[op].kind else 0) and "Generate" not in plan


def test_state_machine(spark):
    asked = ["ANALYZING", "DISCOVERING", "ANALYZING", None, "VALIDATED", "IMPLEMENTING"]
    rows = spark.createDataFrame([(k, i, s) for k in ("x", "y", None) for i, s in enumerate(asked)], "key string, seq long, wanted string")
    for k in ("x", None):
        got = R.advance(rows, R.TASK_STEPS).where(F.col("key").eqNullSafe(F.lit(k))).orderBy("seq").collect()
        assert [r["accepted"] for r in got] == [False, True, True, False, False, True] and got[-1]["state"] == "IMPLEMENTING" and got[0]["from_state"] == "UNKNOWN"


def symbol(i, name, owner, path, calls):
    return (i, name, owner, path, calls)


SYMBOL = "id string, name string, owner string, path string, calls array<string>"


def test_same_named_methods_and_files(spark):
    rows = [
        symbol("1", "Process", "Service", "a.go", ["local", "Worker.Process"]),
        symbol("2", "Process", "Worker", "b.go", ["Process", None, ""]),
        symbol("3", "local", None, "a.go", None),
        symbol("4", "local", "", "b.go", []),
        symbol("5", "only", "", "b.go", ["Ghost.only", "only", "local"]),
        symbol("6", "only", "", "c.py", ["Worker.Process"]),
        symbol("7", None, None, None, ["only"]),
        symbol("8", "stub", "", "d.s", ["only", "local"]),
    ]
    got = {(r["from_id"], r["to_id"]): r["confidence"] for r in V.resolve_calls(spark.createDataFrame(rows, SYMBOL)).collect()}
    assert got == {("1", "3"): 0.9, ("1", "2"): 0.8, ("5", "4"): 0.9, ("8", "5"): 0.8, ("8", "3"): 0.5, ("8", "4"): 0.5}
    assert V.resolve_calls(spark.createDataFrame([], SYMBOL)).count() == 0


def test_a_known_owner_out_of_reach_costs_confidence(spark):
    rows = [symbol("1", "run", "Job", "a.py", []), symbol("2", "run", "", "a.go", []), symbol("3", "go", "", "b.go", ["Job.run", "Nobody.run"])]
    got = {r["to_id"]: r["confidence"] for r in V.resolve_calls(spark.createDataFrame(rows, SYMBOL)).collect()}
    assert got == {"2": 0.8}
    got = {r["to_id"]: r["confidence"] for r in V.resolve_calls(spark.createDataFrame([*rows[:2], symbol("3", "go", "", "b.go", ["Job.run"])], SYMBOL)).collect()}
    assert got == {"2": 0.64}


def test_inheritance(spark):
    types = spark.createDataFrame([("1", "Base", "a.py"), ("2", "Child", "a.py"), ("3", "Base", "b.go"), ("4", None, "c.py")], "id string, name string, path string")
    told = spark.createDataFrame([("a.py", "Child", "extends", "Base"), ("a.py", "Child", "likes", "Base"), ("b.go", "Child", "implements", "Base"), ("a.py", "Base", "extends", "Base")], "path string, sub string, rel string, super string")
    assert [tuple(r) for r in V.resolve_inheritance(types, told).collect()] == [("EXTENDS", "2", "1", 0.9)]


def test_impact_bounds(spark):
    chain = [(f"e{i:03}", "CALLS", f"f{i + 1}", f"f{i}") for i in range(80)]
    edges = spark.createDataFrame(chain + [("x", "CONTAINS", "file", "f0"), ("y", "CALLS", "f0", "f2")], "id string, kind string, from_id string, to_id string")
    got = {r["id"]: (r["distance"], r["via"]) for r in G.impact(edges, "f0", 5).collect()}
    assert got == {f"f{i}": (i, "CALLS") for i in range(1, 6)}
    assert G.impact(edges, "f0", -3).count() == 0 and G.impact(edges, "nobody", 5).count() == 0
    assert G.impact(edges, "f0", 8, 3).count() == 3
    wide = spark.createDataFrame([(f"e{i:04}", "CALLS" if i % 2 else "CONTAINS", f"c{i}", "hub") for i in range(300)], edges.schema)
    assert {r["id"] for r in G.impact(wide, "hub", 1, fan_out=10).collect()} == {"c1", "c3", "c5", "c7", "c9"}


@pytest.mark.parametrize("text, want", [("packet", ["3"]), ("PACK", ["2", "3", "1"]), ("own.parse", ["4"]), ("nope", [])])
def test_find(spark, text, want):
    rows = [("1", "Class", "Packet", "Packet"), ("2", "Function", "packX", "packX"), ("3", "Function", "packet", None), ("4", "Function", "parse", "own.parse"), ("5", "Function", None, None)]
    nodes = spark.createDataFrame(rows, "id string, kind string, name string, qualified_name string")
    assert [r["id"] for r in S.find(nodes, ["Function", "Class"], text, 10).collect()] == want
