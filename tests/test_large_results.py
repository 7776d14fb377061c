"""Queries whose results outgrow a limit that their SQL does not have."""

import os
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__ as entry  # noqa: E402
from tesselode.sources import tables as T  # noqa: E402

QUERIES = entry.queries()


def swapped(spark, sf, folder, name, rows):
    """A folder with the tables of sf, but for one."""
    for f in os.listdir(sf):
        if f != f"{name}.parquet":
            os.symlink(os.path.join(sf, f), folder / f)
    rows.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def test_get_function_tells_every_holder(spark, sf, tmp_path):
    part = spark.read.parquet(f"{sf}/part.parquet").limit(1).drop("p_partkey")
    rows = spark.range(1100).selectExpr("id * 90 + 10 AS p_partkey").where("p_partkey % 41 <> 0").crossJoin(part)
    n = rows.count()
    got = QUERIES["get_function"](spark, swapped(spark, sf, tmp_path, "part", rows)).collect()
    assert n > 1000 and len({r["id"] for r in got}) == len(got) == n


def test_impact_analysis_has_no_limit(spark, sf, tmp_path):
    line = spark.read.parquet(f"{sf}/lineitem.parquet").limit(1).drop("l_partkey", "l_suppkey", "l_orderkey")
    rows = spark.range(10_100).selectExpr("id AS l_partkey", "3L AS l_suppkey", "id % 5 + 1000000 AS l_orderkey").crossJoin(line)
    got = QUERIES["impact_analysis"](spark, swapped(spark, sf, tmp_path, "lineitem", rows)).collect()
    near = [r for r in got if r["distance"] == 1]
    assert len(near) == 10_100 and {r["via"] for r in near} == {"SUPPLIED_BY"}
    assert sorted(r["id"] for r in got if r["distance"] == 2) == [f"Order:{i}" for i in range(1_000_000, 1_000_005)]


def test_bridge_edges_tasks_follow_the_rows(spark, sf, monkeypatch):
    want = QUERIES["bridge_edges"](spark, sf).collect()
    n = spark.read.parquet(f"{sf}/lineitem.parquet").count()
    monkeypatch.setattr("tesselode.plans.graph_queries.PAIR_ROWS", n // 7 + 1, raising=False)
    got = QUERIES["bridge_edges"](spark, sf)
    assert ", 7), REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()
    assert got.collect() == want and len(want) == 50


def test_export_shuffles_keys_and_writes_small_files(spark, sf, monkeypatch, tmp_path):
    monkeypatch.setattr("tesselode.plans.extract_queries.scratch", lambda spark, name: f"{tmp_path}/{name}")
    rows = {(r["record"], r["kind"]): r["n"] for r in QUERIES["export_graph"](spark, sf).collect()}
    files = list(tmp_path.glob("graph/*/part-*"))
    assert files and all(f.name.endswith(".json.gz") for f in files)
    assert rows["edge", "PLACED"] == rows["node", "Order"] > 0
    plan = T.edges(spark, sf, ["CONTAINS"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(l_orderkey#" in plan


def test_get_function_tells_callers_and_callees(spark, sf):
    from tesselode.plans import record_queries as Q

    columns = "id string, kind string, name string, qualified_name string, owner string, path string, size int, calls array<string>"
    rows = [("1", "Function", "Run", "Job.Run", "Job", "a.go", 1, ["help"]), ("2", "Function", "help", "help", "", "a.go", 2, ["Job.Run", "nobody"]), ("3", "Function", "main", "main", "", "b.go", 3, ["Job.Run", "help"]), ("4", "Class", "Run", "Run", "", "b.go", 4, [])]
    own = spark.createDataFrame(rows, columns)
    told = lambda text: sorted((r["id"], r["path"], r["relation"], r["other_id"], r["other_qualified_name"], r["confidence"], r["n_callers"], r["n_callees"]) for r in Q.function_calls(own, text).collect())
    run = [("1", "a.go", "callee", "2", "help", 0.9, 2, 1), ("1", "a.go", "caller", "2", "help", 0.9, 2, 1), ("1", "a.go", "caller", "3", "main", 0.8, 2, 1)]
    # by its qualified name, its name, its name in other letters, and a part of it
    assert told("Job.Run") == told("Run") == told("rUN") == told("ob.r") == run
    assert told("none") == []
    lone = spark.createDataFrame([rows[0][:-1] + ([],)], columns)
    assert [(r["id"], r["relation"], r["n_callers"]) for r in Q.function_calls(lone, "Run").collect()] == [("1", None, 0)]
