"""Extraction, readers and writers: texts are built from the tables, written, read back and taken apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesselode.operators import resolve as V
from tesselode.sources import files as X
from tesselode.sources.tables import GRAPH_SQL, edges, nodes, scratch, table

from .catalog import query
from .report_queries import both


def _sources(spark, d, line: str, ending: str) -> DataFrame:
    """A file for each p_size, with a function of two lines for each part in order of its key."""
    part = F.struct("p_partkey", F.expr(line).alias("x"))
    code = F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["x"]), "\n")
    return table(spark, d, "part").groupBy("p_size").agg(code.alias("content")).select(F.concat(F.lit("size_"), F.col("p_size").cast("string"), F.lit(ending)).alias("path"), "content")


PLACED = "CAST(2 * row_number() OVER (PARTITION BY p_size ORDER BY p_partkey) - 1 AS INT)"


@query("python_symbols", f"SELECT 'size_' || CAST(p_size AS VARCHAR) || '.py' AS path, 'Function' AS kind, 'f_' || CAST(p_partkey AS VARCHAR) AS name, {PLACED} AS line_start, {PLACED} + 1 AS line_end, 'g_' || CAST(p_partkey % 7 AS VARCHAR) AS calls FROM part")
def python_symbols(spark, d):
    code = _sources(spark, d, "concat('def f_', p_partkey, '(a):\\n    return g_', p_partkey % 7, '(a)')", ".py")
    return X.python_symbols(code, failures=True).select("path", "kind", "name", "line_start", "line_end", F.array_join("calls", ",").alias("calls"))


@query("line_symbols", f"SELECT 'size_' || CAST(p_size AS VARCHAR) || '.go' AS path, CASE WHEN p_partkey % 5 = 0 THEN 'Class' ELSE 'Function' END AS kind, 'S' || CAST(p_partkey AS VARCHAR) AS name, {PLACED} AS line_start FROM part")
def line_symbols(spark, d):
    code = _sources(spark, d, "concat(if(p_partkey % 5 = 0, concat('type S', p_partkey, ' struct {'), concat('func S', p_partkey, '(x int) {')), '\\n}')", ".go")
    return X.line_symbols(code.withColumn("language", X.language(F.col("path"))))


@query("markdown_sections", "WITH s AS (SELECT conv_id, turn, role, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS INT) AS section, replace(replace(coalesce(text, ''), '#', ''), chr(10), ' ') AS content FROM conversations) SELECT conv_id, section, 1 AS level, role AS heading, content, CAST(2 * section + 1 AS INT) AS line_start FROM s")
def markdown_sections(spark, d):
    piece = F.struct("turn", F.concat(F.lit("# "), F.col("role"), F.lit("\n"), F.translate(F.coalesce("text", F.lit("")), "\n#", " "), F.lit("\n")).alias("x"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda s: s["x"]), "")
    docs = table(spark, d, "conversations").groupBy("conv_id").agg(text.alias("text"))
    return X.sections(docs, "conv_id", "text")


@query("csv_round_trip", "SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer")
def csv_round_trip(spark, d):
    path = scratch(spark, "csv")
    table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment").write.csv(path, header=True, escape='"')
    return X.read_table(spark, path)


@query("export_graph", f"WITH {GRAPH_SQL} SELECT 'node' AS record, kind, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge', kind, count(*) FROM edges GROUP BY kind")
def export_graph(spark, d):
    path = scratch(spark, "graph")
    nodes(spark, d).write.json(f"{path}/nodes", compression="gzip")
    edges(spark, d).write.json(f"{path}/edges", compression="gzip")
    counted = [spark.read.schema("id string, kind string").json(f"{path}/{x}s").groupBy(F.lit(x).alias("record"), "kind").agg(F.count("*").alias("n")) for x in ("node", "edge")]
    return counted[0].unionByName(counted[1])


def _binaries(spark, d) -> DataFrame:
    """An order is a function of the customer's binary, a line an instruction, a return flag a block."""
    line = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", F.struct(F.col("l_linenumber").cast("string").alias("address"), F.col("l_linestatus").alias("mnemonic"), F.col("l_partkey").cast("string").alias("operands")).alias("i"))
    block = line.groupBy("l_orderkey", "l_returnflag").agg(F.collect_list("i").alias("instructions"))
    function = block.groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_returnflag").alias("address"), "instructions")).alias("basic_blocks"))
    orders = table(spark, d, "orders").join(function, F.col("o_orderkey") == F.col("l_orderkey"))
    made = F.struct(F.col("o_orderkey").cast("string").alias("address"), F.col("o_orderstatus").alias("name"), F.array(F.col("o_orderpriority")).alias("calls"), "basic_blocks")
    path = scratch(spark, "binaries")
    orders.groupBy(F.col("o_custkey").cast("string").alias("binary_id")).agg(F.collect_list(made).alias("functions")).write.json(path)
    return X.read_binaries(spark, path)


@query("binary_instructions", "SELECT CAST(o_custkey AS VARCHAR) AS binary_id, CAST(o_orderkey AS VARCHAR) AS function, l_returnflag AS block, CAST(l_linenumber AS VARCHAR) AS address, l_linestatus AS mnemonic, CAST(l_partkey AS VARCHAR) AS operands FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def binary_instructions(spark, d):
    return X.instructions(_binaries(spark, d))


@query("binary_call_graph", "SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS binary_id, CAST(o_orderkey AS VARCHAR) AS from_function, o_orderpriority AS to_function FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem)")
def binary_call_graph(spark, d):
    return X.binary_calls(_binaries(spark, d))


@query("numstat_churn", "SELECT 'part/' || CAST(l_partkey AS VARCHAR) AS path, count(*) AS changes, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS added, CAST(sum(CASE WHEN l_linenumber = 1 THEN 0 ELSE l_linenumber END) AS BIGINT) AS deleted FROM lineitem GROUP BY l_partkey")
def numstat_churn(spark, d):
    line = F.expr("concat(cast(l_quantity as bigint), '\\t', if(l_linenumber = 1, '-', cast(l_linenumber as string)), '\\tpart/', l_partkey)")
    return X.numstat(table(spark, d, "lineitem").select(line.alias("value"))).groupBy("path").agg(F.count("*").alias("changes"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"))


@query("asof_purchase", "WITH p AS (SELECT user_id, ts, max(event_id) AS last_purchase FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) SELECT e.event_id, p.last_purchase FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts")
def asof_purchase(spark, d):
    """The last purchase up to each error of a user: one shuffle by user, no join."""
    held = table(spark, d, "events").where("event_type IN ('error', 'purchase')")
    last = F.expr("last_value(if(event_type = 'purchase', event_id, null)) IGNORE NULLS OVER (PARTITION BY user_id ORDER BY ts, if(event_type = 'purchase', 0, 1), event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
    return held.select("event_id", "event_type", last.alias("last_purchase")).where("event_type = 'error'").select("event_id", "last_purchase")


both("snippet_window", "SELECT doc_id, substring(text, greatest(1, instr(text, 'the') - 80), 240) AS snippet FROM {documents} WHERE instr(text, 'the') > 0")
both("cfg_edges", "SELECT l_orderkey AS function_id, l_linenumber AS from_block, lead(l_linenumber) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS to_block FROM {lineitem}")
both("longest_prefix", "WITH k AS (SELECT 'PROMO' AS prefix UNION ALL SELECT 'PROMO BRUSHED' UNION ALL SELECT 'STANDARD'), m AS (SELECT p_partkey, prefix, row_number() OVER (PARTITION BY p_partkey ORDER BY length(prefix) DESC) AS r FROM {part} JOIN k ON p_type LIKE concat(prefix, '%')) SELECT p_partkey AS id, prefix AS project FROM m WHERE r = 1")
both("state_transitions", "WITH t AS (SELECT 'O' AS a, 'F' AS b UNION ALL SELECT 'P', 'F' UNION ALL SELECT 'O', 'P'), s AS (SELECT o_orderkey, o_custkey, o_orderstatus AS b, lag(o_orderstatus) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS a FROM {orders}) SELECT s.o_orderkey AS id, s.a AS from_state, s.b AS to_state, CASE WHEN t.a IS NULL THEN 0 ELSE 1 END AS allowed FROM s LEFT JOIN t ON s.a = t.a AND s.b = t.b WHERE s.a IS NOT NULL")
both("ensure_fresh", "WITH l AS (SELECT l_orderkey, max(l_shipdate) AS shipped FROM {lineitem} GROUP BY l_orderkey) SELECT o_orderkey AS id, CASE WHEN shipped IS NULL THEN 'unknown' WHEN shipped > o_orderdate THEN 'stale' ELSE 'fresh' END AS freshness FROM {orders} LEFT JOIN l ON l_orderkey = o_orderkey")
@query("related_tests_rule", "SELECT t.p_partkey AS test_id, p.p_partkey AS id FROM part p JOIN part t ON t.p_brand = p.p_brand AND t.p_size = p.p_size AND t.p_type <> p.p_type AND t.p_name LIKE '%e%' AND t.p_partkey <> p.p_partkey")
def related_tests_rule(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_brand", "p_size", F.col("p_type").alias("type"))
    t = table(spark, d, "part").where("p_name LIKE '%e%'").select(F.col("p_partkey").alias("test_id"), "p_brand", "p_size", F.col("p_type").alias("t_type"))
    return V.paired(p, t, ["p_brand", "p_size"]).where("t_type <> type AND test_id <> id").select("test_id", "id")


both("grouping_sets", "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n, sum(n_chars) AS chars FROM {documents} GROUP BY GROUPING SETS ((lang, source), (source), (lang), ())")
