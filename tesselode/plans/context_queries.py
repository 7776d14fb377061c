"""Contexts for the benchmark items from documents and turns, digests of the turns as records of projects and of prompts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tesselode.operators import context as C
from tesselode.sources.tables import table

from .catalog import query

REQUESTS = "SELECT item_id AS request, CAST(item_id % 7 AS INT) AS level, CAST(3 + item_id % 9 AS INT) AS max_items, CAST(item_id % 4 * 1500 AS INT) AS max_tokens, CASE WHEN item_id % 5 = 0 THEN 'small' ELSE 'full' END AS profile"
_FULL = "SELECT request, CASE WHEN small THEN greatest(lv, 2) ELSE lv END AS lv, CASE WHEN small THEN least(max_items, 6) ELSE max_items END AS most, CASE WHEN small AND max_tokens <= 0 THEN 1200 ELSE max_tokens END AS budget FROM (SELECT *, profile = 'small' AS small, CASE WHEN level BETWEEN 0 AND 5 THEN level ELSE 1 END AS lv FROM (" + REQUESTS + " FROM benchmark))"
#: A text that holds one of these counts as changed.
CHANGED = ["ention", "aux de"]
_TURNS = "SELECT 't' || CAST(conv_id * 1000 + turn AS VARCHAR(20)) AS id, text FROM {conversations}"
_DOCS = "SELECT 'd' || CAST(doc_id AS VARCHAR(20)) AS id, text FROM {documents}"
_LONG = 4


def _finds(section: int, kind: str, rows: str) -> str:
    words = f"(SELECT DISTINCT id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM ({rows.format(documents='documents', conversations='conversations')}))"
    return f"SELECT request, {section} AS section, row_number() OVER (PARTITION BY request ORDER BY n DESC, id) AS pos, '{kind}' AS kind, id, n FROM (SELECT request, id, count(*) AS n FROM q JOIN {words} w USING (word) GROUP BY 1, 2) QUALIFY pos <= 11"


_CONTEXT = (
    f"WITH q AS MATERIALIZED (SELECT * FROM (SELECT DISTINCT item_id AS request, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE length(word) > {_LONG}), r AS ({_FULL}), found AS MATERIALIZED ({_finds(1, 'memory', _TURNS)} UNION ALL {_finds(2, 'doc', _DOCS)}), texts AS ({_TURNS.format(conversations='conversations')} UNION ALL {_DOCS.format(documents='documents')}), "
    "a AS (SELECT f.*, r.lv, r.most, r.budget, CASE WHEN lv >= 2 THEN trim(regexp_replace(coalesce(t.text, ''), '[\\t\\n\\x0B\\f\\r \\x{85}\\x{A0}]+', ' ', 'g')) ELSE coalesce(t.text, '') END AS text, CASE WHEN pos % 4 = 0 THEN 0 ELSE n END AS s0 FROM found f JOIN r USING (request) JOIN texts t USING (id) WHERE pos <= most), "
    "b AS (SELECT * FROM a QUALIFY lv < 2 OR (text <> '' AND row_number() OVER (PARTITION BY request, kind, text ORDER BY section, pos, id) = 1)), "
    "c AS (SELECT *, CASE WHEN lv >= 3 AND s0 = 0 THEN 0.1 ELSE CAST(s0 AS DOUBLE) END AS s1 FROM b), "
    "d AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY s1 DESC, section, pos, id) AS rk FROM c QUALIFY lv < 3 OR rk <= most), "
    f"e AS (SELECT *, lv >= 4 AND ({' OR '.join(f'contains(text, {chr(39)}{c}{chr(39)})' for c in CHANGED)}) AS fresh, (strlen(text) + 3) // 4 + 20 AS cost FROM d), "
    "g AS (SELECT *, row_number() OVER w AS place, sum(cost) OVER (PARTITION BY request ORDER BY section, CASE WHEN lv >= 3 THEN rk ELSE pos END, pos, id ROWS UNBOUNDED PRECEDING) AS used FROM e WINDOW w AS (PARTITION BY request ORDER BY section, CASE WHEN lv >= 3 THEN rk ELSE pos END, pos, id)), "
    "h AS (SELECT *, bool_or(NOT (budget <= 0 OR used <= budget)) OVER (PARTITION BY request) AS truncated FROM g) "
    "SELECT request, section, place, kind, id, md5(text) AS digest, kind || CASE WHEN fresh THEN ' [changed]' ELSE '' END AS source, s1 + CASE WHEN fresh THEN 0.5 ELSE 0 END AS score, CASE WHEN lv >= 5 THEN CASE WHEN kind = 'doc' THEN id || '@docs/' || id ELSE id END END AS provenance, cost, truncated FROM h WHERE budget <= 0 OR used <= budget"
)


def _context(spark, d):
    words = F.array_distinct(F.split(F.lower("text"), "[^a-z]+"))
    items = table(spark, d, "benchmark")
    asked = items.select(F.col("item_id").alias("request"), F.explode(words).alias("word")).where(F.length("word") > _LONG)
    parts = []
    for section, kind, rows, name in ((1, "memory", _TURNS, "conversations"), (2, "doc", _DOCS, "documents")):
        own = spark.sql(rows.format(**{name: f"{{{name}}}"}), **{name: table(spark, d, name)})
        best = F.broadcast(C.matched(own.select("id", words.alias("words")), asked, 11)).join(own, "id")
        parts.append(best.select("request", F.lit(section).alias("section"), "at", F.lit(kind).alias("kind"), "id", "text", F.lit(kind).alias("source"), F.when(F.col("at") % 4 == 0, 0).otherwise(F.col("n")).alias("score")))
    requests = spark.sql(REQUESTS + " FROM {benchmark}", benchmark=items).withColumn("changed", F.array(*[F.lit(c) for c in CHANGED]))
    nodes = table(spark, d, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id")).withColumn("path", F.concat(F.lit("docs/"), "id"))
    return C.compiled(requests, parts[0].unionByName(parts[1]), nodes)


@query("prepare_context", _CONTEXT)
def prepare_context(spark, d):
    return _context(spark, d).withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


@query("explain_context", f"WITH x AS ({_CONTEXT}), s AS (SELECT request, section, count(*) AS n, sum(cost) AS cost, bool_or(truncated) AS truncated FROM x GROUP BY 1, 2) SELECT request, sum(n) AS n_items, sum(cost) AS tokens, bool_or(truncated) AS truncated, string_agg(CAST(section AS VARCHAR) || ': ' || CAST(n AS VARCHAR) || ' items', '; ' ORDER BY section) AS notes FROM s GROUP BY request")
def explain_context(spark, d):
    return C.explained(_context(spark, d))


RECORDS = "SELECT 'p' || CAST(conv_id % 7 AS VARCHAR(20)) AS project, CAST(conv_id * 1000 + turn AS VARCHAR(20)) AS id, CASE turn % 4 WHEN 1 THEN 'decision' WHEN 2 THEN 'convention' ELSE 'note' END AS kind, role AS title, text AS body, turn = 0 AND conv_id % 11 = 0 AS pinned, conv_id * 37 % 101 * 100 + turn AS created FROM {conversations}"
HEADER, HINTS = "Project context:\n", "Relevant project context:\n"
_LINE = "'- [' || kind || '] ' || title || CASE WHEN one = '' THEN '' WHEN length(one) > 200 THEN ': ' || left(one, 200) || '...' ELSE ': ' || one END || chr(10)"
_LINES = f"records AS MATERIALIZED (SELECT *, {_LINE} AS line FROM (SELECT *, trim(regexp_replace(coalesce(body, ''), '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}]+', ' ', 'g')) AS one FROM ({RECORDS.format(conversations='conversations')})))"


def _packed(header: str, budget: int) -> str:
    """Line by line in order: what is used so far, and whether the line was taken."""
    return f"o AS MATERIALIZED (SELECT *, (strlen(line) + 3) // 4 AS cost FROM lines), f AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS n, CAST({(len(header) + 3) // 4} AS BIGINT) AS used, FALSE AS took, '' AS id, '' AS line FROM o UNION ALL SELECT o.key, o.n, f.used + CASE WHEN f.used + o.cost <= {budget} THEN o.cost ELSE 0 END, f.used + o.cost <= {budget}, o.id, o.line FROM f JOIN o ON o.key = f.key AND o.n = f.n + 1) SELECT key, md5('{header.rstrip()}' || chr(10) || string_agg(line, '' ORDER BY n)) AS digest, string_agg(CASE WHEN id <> '' THEN id END, ',' ORDER BY n) AS ids FROM f WHERE took GROUP BY key"


def _told(df):
    return df.select("key", F.md5(F.col("digest").cast("binary")).alias("digest"), F.when(F.size("ids") > 0, F.array_join("ids", ",")).alias("ids"))


@query("session_digest", f"WITH RECURSIVE {_LINES}, lines AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY g, name, created DESC, id) AS n, id, line FROM (SELECT DISTINCT project AS key, 0 AS g, 'style' AS name, 0 AS created, '' AS id, '- preference style: ' || project || chr(10) AS line FROM records UNION ALL SELECT project, CASE WHEN pinned THEN 1 WHEN kind <> 'note' THEN 2 ELSE 3 END, '', created, id, line FROM records UNION ALL SELECT project, 4, '', 0, '', 'Codebase: ' || CAST(count(*) AS VARCHAR) || ' records' || chr(10) FROM records GROUP BY project)), {_packed(HEADER, C.SESSION_BUDGET)}")
def session_digest(spark, d):
    records = spark.sql(RECORDS, conversations=table(spark, d, "conversations"))
    preferences = records.select("project").distinct().select("project", F.lit("style").alias("name"), F.col("project").alias("value"))
    summaries = records.groupBy("project").agg(F.concat(F.lit("Codebase: "), F.count("*").cast("string"), F.lit(" records")).alias("line"))
    return _told(C.session_digest(records, preferences, summaries, HEADER))


#: Prompts are conversations: each asks for the ten turns that follow its own in its project; every third of them was seen.
_HITS = "SELECT a.conv_id AS prompt, a.conv_id AS session, row_number() OVER (PARTITION BY a.conv_id ORDER BY b.conv_id, b.turn) AS pos, CAST(b.conv_id * 1000 + b.turn AS VARCHAR(20)) AS id FROM (SELECT DISTINCT conv_id FROM {conversations}) a JOIN {conversations} b ON b.conv_id IN (a.conv_id + 7, a.conv_id + 14)"


@query("prompt_digest", f"WITH RECURSIVE {_LINES}, hits AS ({_HITS.format(conversations='conversations')}), lines AS (SELECT prompt AS key, row_number() OVER (PARTITION BY prompt ORDER BY pos) AS n, id, line FROM hits JOIN records USING (id) WHERE pos <= 10 AND NOT pinned AND CAST(id AS BIGINT) % 3 <> 0), {_packed(HINTS, C.PROMPT_BUDGET)}")
def prompt_digest(spark, d):
    turns = table(spark, d, "conversations")
    records = spark.sql(RECORDS, conversations=turns)
    after = turns.select((F.explode(F.array(F.col("conv_id") - 7, F.col("conv_id") - 14))).alias("prompt"), "conv_id", "turn").join(turns.select(F.col("conv_id").alias("prompt")).distinct(), "prompt")
    at = F.row_number().over(Window.partitionBy("prompt").orderBy("conv_id", "turn"))
    hits = after.select("prompt", F.col("prompt").alias("session"), at.alias("at"), (F.col("conv_id") * 1000 + F.col("turn")).cast("string").alias("id")).where("at <= 10")
    seen = hits.where(F.col("id").cast("long") % 3 == 0).select("session", "id")
    return _told(C.prompt_digest(hits, records, seen, HINTS))
