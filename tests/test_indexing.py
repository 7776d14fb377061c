"""Passes of the index over small walks: what changed, vanished, moved, and which edges stay."""

from pyspark.sql import functions as F

from tesselode.operators import indexing as I

WALK = "path string, content string, status string"


def walk(spark, files):
    return spark.createDataFrame([(p, c, "x") for p, c in files], WALK)


def code(*functions):
    return "# head\n" + "".join(f"def {n}():\n" + "".join(f"    {c}()\n" for c in calls) for n, calls in functions)


def by(df, key):
    return {r[key]: r["status"] for r in df.collect()}


def test_two_walks_a_listed_path_and_a_cut_walk(spark):
    start = [("a.py", code(("main", ["helper", "local"]), ("local", []))), ("b.py", code(("helper", []), ("old", ["local"]))), ("c.py", code(("local", []))), ("c.py", code(("local", []))), (None, "def x():"), ("n.py", None)]
    one = I.reindex(I.State.empty(spark), walk(spark, start), I.definitions)
    assert by(one.files, "path") == {"a.py": "added", "b.py": "added", "c.py": "added", "n.py": "added"}
    edge = lambda df: {(r["from_id"].split(":")[-1], r["to_id"].split(":")[1], r["to_id"].split(":")[-1], r["confidence"]) for r in df.collect()}
    assert edge(one.state.edges) == {("main", "b.py6", "helper", 0.8), ("main", "a.py5", "local", 0.9), ("old", "a.py5", "local", 0.5), ("old", "c.py5", "local", 0.5)}
    helper, main = (one.state.symbols.where(F.col("name") == n).first()["id"] for n in ("helper", "main"))
    hand = spark.createDataFrame([("h1", "CALLS", main, helper, "manual", 1.0), ("h2", "NOTES", helper, main, None, None), ("h3", "CALLS", main, "gone:before", "manual", 1.0)], I.EDGES)
    state = I.State(one.state.files, one.state.symbols, one.state.edges.unionByName(hand))
    again = I.reindex(state, walk(spark, start), I.definitions)
    assert set(by(again.files, "path").values()) == {"same"} and {r["status"] for r in again.symbols.collect()} == {"same"}
    # an edge drawn by hand stands for the resolver's, a dangling one goes
    assert sorted((r["source"] or "", r["status"]) for r in again.edges.where("status <> 'kept' OR source = 'manual'").collect()) == [("manual", "gone"), ("manual", "kept"), ("resolver", "gone")]
    two = I.reindex(state, walk(spark, [("a.py", start[0][1]), ("b.py", code(("helper", ["fresh"]))), ("d.py", code(("fresh", [])))]), I.definitions)
    assert by(two.files, "path") == {"a.py": "same", "b.py": "changed", "c.py": "vanished", "d.py": "added", "n.py": "vanished"}
    assert {k.split(":")[-1]: v for k, v in by(two.symbols.where("path <> 'c.py'"), "id").items()} == {"main": "same", "local": "same", "helper": "again", "old": "gone", "fresh": "new"}
    assert {r["id"].split(":")[-1] for r in two.affected.collect()} == {"main", "helper", "old", "local", "fresh"}
    row = I.report(two).first()
    assert (row["files_seen"], row["files_changed"], row["files_deleted"], row["functions"], row["symbols_removed"], row["truncated"]) == (3, 2, 2, 4, 2, False)
    # one listed path that is missing, all others are left alone
    listed = spark.createDataFrame([("c.py",), ("a.py",)], "path string")
    part = I.reindex(state, walk(spark, [("a.py", start[0][1]), ("d.py", "def late():\n")]), I.definitions, scope=listed)
    assert by(part.files, "path") == {"a.py": "same", "b.py": "same", "c.py": "vanished", "n.py": "same"}
    cut = I.reindex(state, walk(spark, start), I.definitions, limit=2)
    assert cut.truncated and by(cut.files, "path") == {"a.py": "same", "b.py": "same", "c.py": "same", "n.py": "same"}


def test_no_files(spark):
    done = I.reindex(I.State.empty(spark), walk(spark, []), I.definitions)
    assert done.state.symbols.count() == 0 and I.report(done).first()["files_seen"] == 0


def test_fates_of_symbols_wait_until_they_are_asked_for(spark, monkeypatch):
    written, settle = [], I.settle
    monkeypatch.setattr(I, "settle", lambda df: written.append(df.columns) or settle(df))
    done = I.reindex(I.State.empty(spark), walk(spark, [("a.py", code(("main", ["main2"]), ("main2", [])))]), I.definitions)
    assert ["id", "path", "status"] not in written
    assert {r["status"] for r in done.symbols.collect()} == {"new"} and done.affected.count() == 2
    assert written.count(["id", "path", "status"]) == 1
