"""Report, table, record and stream queries. Where one SQL text serves both engines it is written once."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselode.functions import text_rules as R
from tesselode.sources.tables import table
from tesselode.streaming import windows as W

from .catalog import query


def both(name: str, text: str) -> None:
    """Registers a query in SQL that Spark and the checker read alike; tables stand in braces."""
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))

    def run(spark, d):
        return spark.sql(text, **{t: table(spark, d, t) for t in names})

    query(name, re.sub(r"\{(\w+)\}", r"\1", text))(run)


both("find_substring", "SELECT p_partkey AS id, p_name AS name FROM {part} WHERE lower(p_name) LIKE '%cold%' ORDER BY id LIMIT 20")
both("find_exact", "SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM {customer} WHERE c_name = 'Customer#000000042' OR c_custkey = 42")
both("find_paged", "SELECT c_custkey AS id, c_name AS name FROM {customer} WHERE c_mktsegment = 'BUILDING' ORDER BY id LIMIT 20 OFFSET 5")
both("signature_similar", "SELECT p_partkey AS id, min(p_partkey) OVER (PARTITION BY p_brand, p_size) AS class_id, count(*) OVER (PARTITION BY p_brand, p_size) - 1 AS n_similar FROM {part} WHERE p_brand IS NOT NULL AND p_size IS NOT NULL")
both("module_summary", "SELECT n_name AS module, count(*) AS n_symbols, sum(CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END) AS n_functions FROM {nation} JOIN {customer} ON n_nationkey = c_nationkey GROUP BY n_name")
both("entry_points_rule", "SELECT p_partkey AS id, p_name AS name FROM {part} WHERE lower(p_name) LIKE 'main%' OR lower(p_name) LIKE 's%' OR lower(p_name) IN ('init', 'handler', 'run') ORDER BY id LIMIT 50")
both("related_by_name_rule", "SELECT p_partkey AS id, p_type AS type FROM {part} WHERE p_type LIKE '%TIN' OR p_type LIKE 'PROMO%' ORDER BY id LIMIT 50")
both("churn", "SELECT l_partkey AS path, count(*) AS changes, round(sum(l_quantity), 2) AS added, round(sum(l_tax), 4) AS deleted FROM {lineitem} GROUP BY l_partkey ORDER BY changes DESC, path LIMIT 100")
both("ownership", "SELECT l_suppkey AS author, count(*) AS n_lines, count(DISTINCT l_partkey) AS n_files FROM {lineitem} GROUP BY l_suppkey")
both("hunk_overlap", "SELECT a.l_orderkey, a.l_linenumber AS hunk, b.l_linenumber AS symbol FROM {lineitem} a JOIN {lineitem} b ON a.l_orderkey = b.l_orderkey AND a.l_linenumber < b.l_linenumber AND a.l_quantity <= b.l_quantity + 5 AND b.l_quantity <= a.l_quantity + 5")
both("span_innermost", "WITH c AS (SELECT a.o_orderkey AS id, b.o_orderkey AS span, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_totalprice, b.o_orderkey) AS r FROM {orders} a JOIN {orders} b ON a.o_custkey = b.o_custkey AND a.o_orderkey <> b.o_orderkey AND b.o_totalprice >= a.o_totalprice) SELECT id, span FROM c WHERE r = 1")
both("slice_math", "SELECT l_orderkey, l_linenumber, l_linenumber + CAST(l_quantity AS BIGINT) AS slice_end, CASE WHEN l_linenumber + CAST(l_quantity AS BIGINT) <= 50 THEN 1 ELSE 0 END AS valid FROM {lineitem}")
both("porting_status", "SELECT l_partkey AS function_id, round(least(1.0, 0.3 * sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) + 0.1 * count(*)), 4) AS progress, max(CASE WHEN l_discount > 0.09 THEN 1 ELSE 0 END) AS blocked FROM {lineitem} GROUP BY l_partkey")
both("mismatch_summary", "SELECT l_suppkey AS function_id, count(*) AS tests, sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS matches, sum(CASE WHEN l_tax > 0.06 THEN 1 ELSE 0 END) AS severe FROM {lineitem} GROUP BY l_suppkey")
both("security_metrics", "SELECT source AS cwe, count(*) AS findings, sum(CASE WHEN text LIKE '%token%' THEN 1 ELSE 0 END) AS high FROM {documents} GROUP BY source")
both("table_query", "SELECT CAST(c_custkey AS STRING) AS id, c_name AS name FROM {customer} WHERE CAST(c_nationkey AS STRING) = '7' ORDER BY c_custkey LIMIT 20")
both("profile", "SELECT count(*) AS documents, sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS english, count(DISTINCT source) AS sources, max(n_chars) AS longest FROM {documents}")
both("project_stats", "SELECT lang, source, count(*) AS n, sum(n_chars) AS chars FROM {documents} GROUP BY lang, source")
both("language_rollup", "SELECT coalesce(lang, 'all') AS lang, coalesce(source, 'all') AS source, count(*) AS n FROM {documents} GROUP BY ROLLUP (lang, source)")
both("usage_rollup", "WITH s AS (SELECT user_id, event_type, count(*) AS calls, round(sum(value), 4) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM {events} GROUP BY user_id, event_type) SELECT user_id, event_type, calls, ms FROM s WHERE r <= 3")
both("context_budget", "WITH c AS (SELECT conv_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS cost FROM {conversations}), r AS (SELECT conv_id, turn, cost, sum(cost) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM c) SELECT conv_id, turn, cost, CAST(used AS BIGINT) AS used FROM r WHERE used <= 500")
both("cache_retention", "WITH r AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM {events}) SELECT event_id, user_id FROM r WHERE r <= 5")
both("cache_stats", "SELECT user_id, count(*) AS lookups, sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS hits, round(sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) * 1.0 / count(*), 6) AS hit_rate FROM {events} GROUP BY user_id")
both("obs_resolve", "SELECT e.event_id, CASE WHEN c.c_custkey IS NOT NULL THEN c.c_name WHEN s.s_suppkey IS NOT NULL THEN s.s_name ELSE 'unknown' END AS entity, CASE WHEN c.c_custkey IS NOT NULL THEN 0.9 WHEN s.s_suppkey IS NOT NULL THEN 0.5 ELSE 0.0 END AS confidence FROM {events} e LEFT JOIN {customer} c ON c.c_custkey = e.user_id AND e.event_type = 'purchase' LEFT JOIN {supplier} s ON s.s_suppkey = e.user_id")
both("contradictions", "SELECT a.event_id AS a, b.event_id AS b FROM {events} a JOIN {events} b ON a.user_id = b.user_id AND a.event_id < b.event_id AND b.event_id - a.event_id < 50 AND a.event_type = 'error' AND b.event_type = 'purchase'")
both("session_warmth", "SELECT user_id, CASE WHEN sum(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) > 0.3 * count(*) AND count(*) > 10 THEN 'hot' WHEN count(*) > 10 THEN 'warm' ELSE 'cold' END AS warmth FROM {events} GROUP BY user_id")
both("active_last_n", "WITH r AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM {events}), l AS (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM r WHERE r = 1) SELECT user_id, event_type, event_id FROM l WHERE n <= 3")
both("hot_topk", "SELECT l_partkey AS id, count(*) AS accesses FROM {lineitem} GROUP BY l_partkey ORDER BY accesses DESC, id LIMIT 100")
both("latest_wins", "WITH r AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM {orders}) SELECT o_custkey AS id, o_orderkey AS version, o_orderstatus AS state FROM r WHERE r = 1")
both("sync_edges_diff", "WITH want AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM {lineitem} WHERE l_quantity > 25), have AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM {lineitem} WHERE l_quantity < 40) SELECT 'add' AS action, a, b FROM (SELECT a, b FROM want EXCEPT SELECT a, b FROM have) x UNION ALL SELECT 'remove', a, b FROM (SELECT a, b FROM have EXCEPT SELECT a, b FROM want) y")
both("list_tasks", "SELECT o_orderkey AS task_id, o_orderstatus AS state FROM {orders} WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, task_id LIMIT 20")
both("eval_weighted", "WITH m AS (SELECT avg(CAST(CASE WHEN quality = 1 THEN 1 ELSE 0 END AS DOUBLE)) AS q, avg(CAST(CASE WHEN toxic = 0 THEN 1 ELSE 0 END AS DOUBLE)) AS t FROM {labels}) SELECT round((0.4 * q + 0.2 * t) / 0.6 * 100, 4) AS score FROM m")
both("team_context", "SELECT n.n_name AS team, count(DISTINCT c.c_custkey) AS members, count(o.o_orderkey) AS tasks FROM {nation} n JOIN {customer} c ON c.c_nationkey = n.n_nationkey LEFT JOIN {orders} o ON o.o_custkey = c.c_custkey GROUP BY n.n_name")
both("pricing_summary", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus")


@query("scd2_supersede", "SELECT o_custkey AS id, o_orderkey AS version, o_orderdate AS valid_from, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS valid_to FROM orders")
def scd2_supersede(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return table(spark, d, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderkey").alias("version"), F.col("o_orderdate").alias("valid_from"), F.lead("o_orderdate").over(w).alias("valid_to"))


@query("cache_key", "SELECT event_id, sha256(event_type || '|' || CAST(user_id AS VARCHAR)) AS cache_key FROM events")
def cache_key(spark, d):
    return table(spark, d, "events").select("event_id", F.sha2(F.concat_ws("|", "event_type", F.col("user_id").cast("string")), 256).alias("cache_key"))


LOOP = "SELECT event_id, user_id, event_type AS subject, event_id * 700000 + user_id * 1000 AS t FROM "


@query("loop_rule_30s", f"WITH h AS ({LOOP} events) SELECT a.event_id, count(*) AS recent FROM h a JOIN h b ON a.subject = b.subject AND b.t <= a.t AND b.t > a.t - 30000000 GROUP BY a.event_id HAVING count(*) > 5")
def loop_rule_30s(spark, d):
    """More than five claims on a subject within the last 30 seconds."""
    h = spark.sql(LOOP + "{events}", events=table(spark, d, "events"))
    w = Window.partitionBy("subject").orderBy("t").rangeBetween(-29_999_999, 0)
    return h.withColumn("recent", F.count("*").over(w)).where("recent > 5").select("event_id", "recent")


COUNTS = "SELECT l_orderkey AS id, sum(CASE WHEN l_quantity > 10 THEN CAST(floor(l_quantity / 5) AS BIGINT) ELSE 0 END) AS changed, sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END) AS untested, sum(CASE WHEN l_discount > 0.08 THEN 1 ELSE 0 END) AS fan_in, sum(CASE WHEN l_tax > 0.07 THEN 1 ELSE 0 END) AS wide, sum(CASE WHEN l_quantity < 3 THEN 1 ELSE 0 END) AS stale FROM {} GROUP BY l_orderkey"


@query("risk_level", f"WITH c AS ({COUNTS.format('lineitem')}), s AS (SELECT id, CASE WHEN changed > 25 THEN 2 WHEN changed > 0 THEN 1 ELSE 0 END + 2 * least(fan_in, 2) + 2 * least(wide, 2) + least(untested, 3) + CASE WHEN stale > 0 THEN 1 ELSE 0 END AS score FROM c) SELECT id, CASE WHEN score >= 6 THEN 'high' WHEN score >= 2 THEN 'medium' ELSE 'low' END AS risk FROM s")
def risk_level(spark, d):
    c = spark.sql(COUNTS.format("{lineitem}"), lineitem=table(spark, d, "lineitem"))
    return c.select("id", R.risk_level(*[F.col(x) for x in ("changed", "untested", "fan_in", "wide", "stale")]).alias("risk"))


@query("table_schema", "SELECT 'customer' AS document_id, count(*) AS row_count, 'c_acctbal,c_custkey,c_mktsegment,c_name,c_nationkey' AS columns FROM customer")
def table_schema(spark, d):
    c = table(spark, d, "customer")
    return c.agg(F.count("*").alias("row_count")).select(F.lit("customer").alias("document_id"), "row_count", F.lit(",".join(sorted(c.columns))).alias("columns"))


@query("retention_score", "WITH l AS (SELECT conv_id, turn, role, length(text) AS n FROM conversations) SELECT conv_id, round(sum(CASE WHEN role = 'user' THEN n ELSE 0 END) * 1.0 / sum(n), 6) AS retention FROM l GROUP BY conv_id")
def retention_score(spark, d):
    n = F.length("text")
    c = table(spark, d, "conversations").groupBy("conv_id")
    return c.agg(F.round(F.sum(F.when(F.col("role") == "user", n).otherwise(0)) / F.sum(n), 6).alias("retention"))


@query("digest_pack", "SELECT conv_id, string_agg(CAST(turn AS VARCHAR) || ':' || role, ';' ORDER BY turn) AS digest FROM conversations GROUP BY conv_id")
def digest_pack(spark, d):
    part = F.struct("turn", F.concat_ws(":", F.col("turn").cast("string"), "role").alias("x"))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda s: s["x"]), ";").alias("digest"))


@query("eval_mrr", "WITH r AS (SELECT d.source, l.quality, row_number() OVER (PARTITION BY d.source ORDER BY d.n_chars DESC, d.doc_id) AS rank FROM documents d JOIN labels l ON d.doc_id = l.doc_id), f AS (SELECT source, min(rank) AS first FROM r WHERE quality = 1 GROUP BY source) SELECT round(avg(1.0 / first), 6) AS mrr, round(avg(CASE WHEN first <= 5 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_5 FROM f")
def eval_mrr(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "doc_id")
    r = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").withColumn("rank", F.row_number().over(w))
    f = r.where("quality = 1").groupBy("source").agg(F.min("rank").alias("first"))
    return f.agg(F.round(F.avg(1 / F.col("first")), 6).alias("mrr"), F.round(F.avg((F.col("first") <= 5).cast("double")), 6).alias("hit_at_5"))


LINE = "(CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' ELSE 'INFO' END || ': user ' || CAST(user_id AS VARCHAR) || ' ' || event_type || ' code ' || CAST(event_id % 7 AS VARCHAR))"
SEVERITY = "CASE WHEN contains(line, 'FATAL') THEN 'fatal' WHEN contains(line, 'ERROR') THEN 'error' WHEN contains(line, 'WARN') THEN 'warning' WHEN contains(line, 'INFO') THEN 'info' WHEN contains(line, 'DEBUG') THEN 'debug' ELSE 'unknown' END"
LINES = f"WITH l AS (SELECT event_id, ts, {LINE} AS line FROM events)"
TEMPLATES = f"{LINES} SELECT regexp_replace(line, '[0-9]+', '%', 'g') AS template, {SEVERITY} AS severity, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM l GROUP BY 1, 2"


@query("log_parse", f"{LINES} SELECT event_id, {SEVERITY} AS severity, regexp_extract(line, 'user ([0-9]+)', 1) AS user_text, regexp_extract(line, 'code ([0-9]+)', 1) AS code FROM l")
def log_parse(spark, d):
    x = W.lines(table(spark, d, "events"))
    return x.select("event_id", R.severity(F.col("line")).alias("severity"), F.regexp_extract("line", "user ([0-9]+)", 1).alias("user_text"), F.regexp_extract("line", "code ([0-9]+)", 1).alias("code"))


@query("log_templates", TEMPLATES)
def log_templates(spark, d):
    return W.templates(table(spark, d, "events"))


@query("severity_counts", f"{LINES} SELECT {SEVERITY} AS severity, count(*) AS n FROM l GROUP BY 1")
def severity_counts(spark, d):
    return W.lines(table(spark, d, "events")).groupBy(R.severity(F.col("line")).alias("severity")).agg(F.count("*").alias("n"))


@query("stream_templates", TEMPLATES)
def stream_templates(spark, d):
    return W.drain(W.templates(W.source(spark, d)), "update", ["template", "severity"])


@query("stream_tumbling", "SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return W.drain(W.tumbling(W.source(spark, d)), "update", ["window_start", "event_type"])


@query("stream_sliding", "WITH w AS (SELECT date_trunc('day', ts) AS window_start, event_type FROM events UNION ALL SELECT date_trunc('day', ts) - INTERVAL 1 DAY, event_type FROM events) SELECT window_start, event_type, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding(spark, d):
    return W.drain(W.sliding(W.source(spark, d)), "update", ["window_start", "event_type"])


@query("sessions_batch", "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k")
def sessions_batch(spark, d):
    return W.sessions(W.timed(table(spark, d, "events")))


@query("stream_dedupe", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedupe(spark, d):
    return W.drain(W.distinct_users(W.source(spark, d)), "append")
