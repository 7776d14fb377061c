"""Graph, resolver and report queries over the key graph."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselode.operators import graph as G
from tesselode.operators import minisql
from tesselode.operators import resolve as V
from tesselode.sources.tables import EDGES_SQL, GRAPH_SQL, edges, key_edges, key_number, key_text, nodes, table

from .catalog import query

HUB = "Nation:7"
#: Lines whose pairs of customer and supplier a task counts.
PAIR_ROWS = 1 << 18
#: Ring edges between nations, and chords, as a graph with cycles that the keys lack.
RING = "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS from_id, 'n' || CAST((n_nationkey + 1) % 25 AS VARCHAR) AS to_id, 'R' || CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 5 <> 4 OR n_nationkey = 9"
CHORDS = "SELECT 'n' || CAST(n_nationkey AS VARCHAR) AS from_id, 'n' || CAST(n_nationkey - 3 AS VARCHAR) AS to_id, 'C' || CAST(n_nationkey AS VARCHAR) AS id FROM nation WHERE n_nationkey % 4 = 3 AND n_nationkey < 16"
RINGS = f"ring AS ({RING} UNION ALL {CHORDS})"
DAG = "SELECT DISTINCT 'n' || CAST(n_nationkey AS VARCHAR) AS from_id, 'n' || CAST(n_nationkey // 2 AS VARCHAR) AS to_id FROM nation WHERE n_nationkey > 0"


def ring(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"))
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    k = F.col("k")
    one = n.where((k % 5 != 4) | (k == 9)).select(name(k).alias("from_id"), name((k + 1) % 25).alias("to_id"), F.concat(F.lit("R"), k.cast("string")).alias("id"))
    two = n.where((k % 4 == 3) & (k < 16)).select(name(k).alias("from_id"), name(k - 3).alias("to_id"), F.concat(F.lit("C"), k.cast("string")).alias("id"))
    return one.unionByName(two)


def dag(spark, d):
    k = F.col("n_nationkey")
    name = lambda c: F.concat(F.lit("n"), c.cast("string"))
    return table(spark, d, "nation").where(k > 0).select(name(k).alias("from_id"), name(F.floor(k / 2)).alias("to_id")).distinct()


@query("graph_counts_by_kind", f"WITH {GRAPH_SQL} SELECT 'node' AS what, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def graph_counts_by_kind(spark, d):
    count = lambda df, what: df.groupBy("kind").agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "kind", "n")
    return count(nodes(spark, d), "node").unionByName(count(edges(spark, d), "edge"))


def _near(direction, near, far):
    return f"SELECT e.id AS edge_id, e.kind AS edge_kind, '{direction}' AS direction, n.id, n.kind, n.name FROM edges e JOIN nodes n ON n.id = e.{far} WHERE e.{near} = '{HUB}'"


OUT, IN = _near("out", "from_id", "to_id"), _near("in", "to_id", "from_id")


@query("neighbors_out", f"WITH {GRAPH_SQL} {OUT}")
def neighbors_out(spark, d):
    return G.neighbors(nodes(spark, d), edges(spark, d), HUB, "out")


@query("neighbors_in", f"WITH {GRAPH_SQL} {IN}")
def neighbors_in(spark, d):
    return G.neighbors(nodes(spark, d), edges(spark, d), HUB, "in")


@query("neighbors_both", f"WITH {GRAPH_SQL} {OUT} UNION ALL {IN}")
def neighbors_both(spark, d):
    return G.neighbors(nodes(spark, d), edges(spark, d), HUB, "both")


WALK = "WITH RECURSIVE {graph}, walk AS (SELECT '{start}' AS id, 0 AS distance UNION SELECT e.{far}, w.distance + 1 FROM walk w JOIN {edges} e ON e.{near} = w.id WHERE w.distance < {depth}), best AS (SELECT id, min(distance) AS distance FROM walk GROUP BY id)"


@query("impact_bfs", WALK.format(graph=GRAPH_SQL, start="Region:1", far="from_id", near="to_id", edges="edges", depth=3) + " SELECT b.id, b.distance, min(e.id) AS via FROM best b JOIN edges e ON e.from_id = b.id JOIN best p ON p.id = e.to_id AND p.distance = b.distance - 1 GROUP BY b.id, b.distance")
def impact_bfs(spark, d):
    return G.reach(edges(spark, d), spark.range(1).select(F.lit("Region:1").alias("id")), 3)


@query("impact_ring", WALK.format(graph=RINGS, start="n7", far="from_id", near="to_id", edges="ring", depth=6) + " SELECT b.id, b.distance, min(e.id) AS via FROM best b JOIN ring e ON e.from_id = b.id JOIN best p ON p.id = e.to_id AND p.distance = b.distance - 1 GROUP BY b.id, b.distance")
def impact_ring(spark, d):
    return G.reach(ring(spark, d), spark.range(1).select(F.lit("n7").alias("id")), 6)


@query("trace_path", f"WITH RECURSIVE {RINGS}, walk AS (SELECT 'n5' AS id, 'n5' AS path, 0 AS hops UNION ALL SELECT e.to_id, w.path || '>' || e.to_id, w.hops + 1 FROM walk w JOIN ring e ON e.from_id = w.id WHERE w.hops < 8) SELECT path, hops FROM walk WHERE id = 'n11' ORDER BY hops, path LIMIT 1")
def trace_path(spark, d):
    return G.shortest_path(ring(spark, d), "n5", "n11", 8)


@query("hierarchy_up_down", f"WITH RECURSIVE {GRAPH_SQL}, up AS (SELECT '{HUB}' AS id, 0 AS level UNION SELECT e.to_id, u.level + 1 FROM up u JOIN edges e ON e.from_id = u.id AND e.kind IN ('IN_REGION', 'IN_NATION') WHERE u.level < 3), down AS (SELECT '{HUB}' AS id, 0 AS level UNION SELECT e.from_id, u.level + 1 FROM down u JOIN edges e ON e.to_id = u.id AND e.kind IN ('IN_REGION', 'IN_NATION') WHERE u.level < 3) SELECT 'super' AS direction, id, min(level) AS level FROM up WHERE level > 0 GROUP BY id UNION ALL SELECT 'sub', id, min(level) FROM down WHERE level > 0 GROUP BY id")
def hierarchy_up_down(spark, d):
    e, start = edges(spark, d, ["IN_REGION", "IN_NATION"]), spark.range(1).select(F.lit(HUB).alias("id"))
    walk = lambda name, inbound: G.reach(e, start, 3, inbound).select(F.lit(name).alias("direction"), "id", F.col("distance").alias("level"))
    return walk("super", False).unionByName(walk("sub", True))


CLOSURE = f"WITH RECURSIVE {RINGS}, paths AS (SELECT from_id AS src, to_id AS dst FROM ring UNION SELECT p.src, e.to_id FROM paths p JOIN ring e ON e.from_id = p.dst)"


@query("hot_paths_topk", f"{CLOSURE} SELECT dst AS id, count(DISTINCT src) AS callers FROM paths GROUP BY dst ORDER BY callers DESC, id LIMIT 10")
def hot_paths_topk(spark, d):
    return G.closure(ring(spark, d)).groupBy(F.col("dst").alias("id")).agg(F.count_distinct("src").alias("callers")).orderBy(F.desc("callers"), "id").limit(10)


@query("scc_cycles", f"{CLOSURE}, own AS (SELECT x.src AS id, min(x.dst) AS component, count(*) AS size FROM paths x JOIN paths y ON x.src = y.dst AND x.dst = y.src GROUP BY x.src) SELECT * FROM own WHERE size > 1")
def scc_cycles(spark, d):
    return G.strong_components(ring(spark, d))


@query("module_layers", f"WITH RECURSIVE dag AS ({DAG}), down AS (SELECT from_id AS id, to_id AS at, 1 AS level FROM dag UNION SELECT w.id, e.to_id, w.level + 1 FROM down w JOIN dag e ON e.from_id = w.at) SELECT id, max(level) AS level FROM down GROUP BY id UNION ALL SELECT DISTINCT to_id, 0 FROM dag WHERE to_id NOT IN (SELECT from_id FROM dag)")
def module_layers(spark, d):
    return G.layers(dag(spark, d)).select("id", "level")


# the key graph with cycles: every third order points back at its customer, nations are a ring
BACK = "SELECT 'Order:' || CAST(o_orderkey AS VARCHAR(20)) AS from_id, 'Customer:' || CAST(o_custkey AS VARCHAR(20)) AS to_id FROM {orders} WHERE o_orderkey % 3 = 0 UNION ALL SELECT 'Nation:' || CAST(n_nationkey AS VARCHAR(20)), 'Nation:' || CAST((n_nationkey + 1) % 25 AS VARCHAR(20)) FROM {nation}"
LOOPED = f"WITH {GRAPH_SQL}, looped AS MATERIALIZED (SELECT from_id, to_id FROM edges UNION ALL {BACK.format(orders='orders', nation='nation')}), ids AS (SELECT from_id AS id FROM looped UNION SELECT to_id FROM looped), own AS MATERIALIZED (SELECT i.id, CASE WHEN i.id LIKE 'Nation:%' THEN 'Nation:0' WHEN b.to_id IS NOT NULL THEN b.to_id ELSE i.id END AS component FROM ids i LEFT JOIN ({BACK.format(orders='orders', nation='nation')}) b ON b.from_id = i.id)"
DAG_OF_COMPONENTS = "left_end AS MATERIALIZED (SELECT a.component AS f, e.to_id FROM looped e JOIN own a ON a.id = e.from_id), dag AS MATERIALIZED (SELECT DISTINCT f, t FROM (SELECT f, b.component AS t FROM left_end JOIN own b ON b.id = left_end.to_id) WHERE f <> t)"
#: Levels follow from the kinds: the condensed graph has no way that repeats one.
LEVELS = f"l0 AS (SELECT component, max(CASE WHEN id LIKE 'Region:%' THEN 0 WHEN id LIKE 'Nation:%' THEN 1 WHEN id LIKE 'Supplier:%' THEN 2 ELSE 0 END) AS level FROM own GROUP BY component), {DAG_OF_COMPONENTS}, " + ", ".join(f"l{i} AS MATERIALIZED (SELECT l.component, greatest(l.level, coalesce(max(n.level + 1), 0)) AS level FROM l{i - 1} l LEFT JOIN dag ON dag.f = l.component LEFT JOIN l{i - 1} n ON n.component = dag.t GROUP BY l.component, l.level)" for i in range(1, 7))


def looped(spark, d):
    back = spark.sql(BACK, orders=table(spark, d, "orders"), nation=table(spark, d, "nation"))
    return edges(spark, d).select("from_id", "to_id").unionByName(back)


def looped_numbers(spark, d):
    """looped with numbers instead of texts, and edges that may stand more than once."""
    orders = table(spark, d, "orders").where("o_orderkey % 3 = 0").select(key_number("Order", "o_orderkey").alias("from_id"), key_number("Customer", "o_custkey").alias("to_id"))
    nation = F.col("n_nationkey")
    ring = table(spark, d, "nation").withColumn("next", (nation + 1) % 25).select(key_number("Nation", "n_nationkey").alias("from_id"), key_number("Nation", "next").alias("to_id"))
    return key_edges(spark, d).unionByName(orders.unionByName(ring).where("from_id IS NOT NULL AND to_id IS NOT NULL"))


@query("graph_components", LOOPED + " SELECT id, component, n AS size FROM (SELECT *, count(*) OVER (PARTITION BY component) AS n FROM own) WHERE n > 1")
def graph_components(spark, d):
    return G.strong_components(looped(spark, d))


@query("graph_condensed", f"{LOOPED}, {DAG_OF_COMPONENTS} SELECT f AS from_id, t AS to_id FROM dag")
def graph_condensed(spark, d):
    _, between = G.contracted(looped_numbers(spark, d), rank=key_text)
    return between.distinct().select(*[key_text(F.col(c)).alias(c) for c in ("from_id", "to_id")])


@query("graph_layers", f"{LOOPED}, {LEVELS} SELECT own.id, own.component, l6.level FROM own JOIN l6 ON l6.component = own.component")
def graph_layers(spark, d):
    found = G.layers_of_numbers(looped_numbers(spark, d), rank=key_text)
    return found.select(*[key_text(F.col(c)).alias(c) for c in ("id", "component")], "level")


@query("community_lpa")
def community_lpa(spark, d):
    return G.label_propagation(ring(spark, d))


@query("degree_topk", f"WITH edges AS ({EDGES_SQL}), ends AS (SELECT from_id AS id FROM edges UNION ALL SELECT to_id FROM edges) SELECT id, count(*) AS degree FROM ends GROUP BY id ORDER BY degree DESC, id LIMIT 10")
def degree_topk(spark, d):
    return G.degrees(edges(spark, d)).orderBy(F.desc("degree"), "id").limit(10)


@query("bridge_edges", "SELECT c_custkey, s_suppkey, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE a.n_regionkey <> b.n_regionkey GROUP BY c_custkey, s_suppkey ORDER BY n DESC, c_custkey, s_suppkey LIMIT 50")
def bridge_edges(spark, d):
    t = lambda n: table(spark, d, n)
    region = t("nation").select("n_nationkey", "n_regionkey")
    # nearly every line is a pair of its own, so tasks follow the lines and what a task sorts or counts stays small
    tasks = max(1, -(-t("lineitem").count() // PAIR_ROWS))
    placed = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(region.toDF("c_nationkey", "c_region"), "c_nationkey").select("o_orderkey", "c_custkey", "c_region")
    line = t("lineitem").join(t("supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(region.toDF("s_nationkey", "s_region"), "s_nationkey").select("l_orderkey", "s_suppkey", "s_region")
    x = line.repartition(tasks, "l_orderkey").join(placed.repartition(tasks, "o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey")).where("c_region <> s_region").select("c_custkey", "s_suppkey")
    return x.repartition(tasks, "c_custkey", "s_suppkey").groupBy("c_custkey", "s_suppkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "c_custkey", "s_suppkey").limit(50)


PICK = "cand AS (SELECT a.p_partkey AS caller, b.p_partkey AS target, a.p_brand = b.p_brand AS same_file FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_partkey <> b.p_partkey), ranked AS (SELECT *, count(*) OVER (PARTITION BY caller) AS n, max(CASE WHEN same_file THEN 1 ELSE 0 END) OVER (PARTITION BY caller) AS any_same FROM cand), edge AS (SELECT caller, target, CASE WHEN any_same = 1 THEN CASE WHEN same_file THEN 0.9 END WHEN n = 1 THEN 0.8 WHEN n <= 3 THEN 0.5 END AS confidence FROM ranked)"


def _near_targets(p):
    """(caller, target) of parts of one name and brand."""
    return V.paired(p, p.select(F.col("caller").alias("target"), "p_type", "p_size", "p_brand"), ["p_type", "p_size", "p_brand"]).where("caller <> target").select("caller", "target")


def _targets(spark, d):
    """Calls by (type, size) to parts of that name: same brand 0.9, unique 0.8, up to three 0.5, else none."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("caller"), "p_type", "p_size", "p_brand")
    near = _near_targets(p).withColumn("confidence", F.lit(0.9))
    # a name is one row with its count and no more holders than an ambiguous name may have, and one
    first = F.row_number().over(Window.partitionBy("p_type", "p_size").orderBy("caller"))
    few = p.withColumn("r", first).where("r <= 5").groupBy("p_type", "p_size").agg(F.count("*").alias("n"), F.collect_list("caller").alias("targets"))
    shared = p.groupBy("p_type", "p_size", "p_brand").agg(F.min("caller").alias("x"), F.max("caller").alias("y")).where("x < y").drop("x", "y")
    alone = p.join(shared, ["p_type", "p_size", "p_brand"], "left_anti").join(few.where("n BETWEEN 2 AND 4"), ["p_type", "p_size"])
    far = alone.select("caller", F.explode("targets").alias("target"), F.when(F.col("n") == 2, 0.8).otherwise(0.5).alias("confidence")).where("caller <> target")
    return near.unionByName(far)


@query("resolve_targets", f"WITH {PICK} SELECT caller, target, CAST(confidence AS DOUBLE) AS confidence FROM edge WHERE confidence IS NOT NULL")
def resolve_targets(spark, d):
    return _targets(spark, d)


@query("resolve_data_flow", f"WITH {PICK} SELECT DISTINCT e.target AS from_id, e.caller AS to_id FROM edge e JOIN part p ON p.p_partkey = e.caller JOIN part q ON q.p_partkey = e.target WHERE e.confidence IS NOT NULL AND p.p_brand = q.p_brand")
def resolve_data_flow(spark, d):
    # a target of another file never has the caller's brand, as it would then be one of the same file
    p = table(spark, d, "part").select(F.col("p_partkey").alias("caller"), "p_type", "p_size", "p_brand").distinct()
    return _near_targets(p).select(F.col("target").alias("from_id"), F.col("caller").alias("to_id"))


@query("resolve_uses", "SELECT DISTINCT s.s_suppkey AS user_id, p.p_partkey AS type_id FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey JOIN part p ON l.l_partkey = p.p_partkey WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = p.p_partkey AND c.c_acctbal < 0)")
def resolve_uses(spark, d):
    taken = table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("p_partkey"))
    parts = table(spark, d, "part").join(taken, "p_partkey", "left_anti")
    used = table(spark, d, "lineitem").select("l_suppkey", "l_partkey").distinct()
    x = used.join(parts, F.col("l_partkey") == F.col("p_partkey")).join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(F.col("s_suppkey").alias("user_id"), F.col("p_partkey").alias("type_id"))


@query("minisql_select", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING' AND c_name LIKE '%1%' ORDER BY id LIMIT 25")
def minisql_select(spark, d):
    n = table(spark, d, "customer").select(F.lit("Customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return minisql.run(n, "SELECT * FROM Customer WHERE segment = :s AND name LIKE '%1%' LIMIT 25", {"s": "BUILDING"}).drop("kind")
