"""Turns as memories that mention words of the benchmark items: stored, searched and folded."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.operators import memory as M
from tesselode.plans.search_queries import BM25, TOP, _terms, _stem
from tesselode.sources.tables import table

from .catalog import query

#: A log: each turn is stored, every fifth conversation's turns once more with a line less known.
_LOG = "SELECT 'p' || CAST(conv_id % 3 AS VARCHAR(20)) AS project, 't' || CAST(conv_id AS VARCHAR(20)) || '-' || CAST(turn AS VARCHAR(20)) AS title, text || chr(10) || 'Thanks  to all ' || chr(10) || CASE WHEN turn % 2 = 0 THEN 'THANKS to all' ELSE role END AS content, 'note' AS kind, role AS agent, CAST(conv_id % 10 AS VARCHAR(20)) AS created, 1 AS seq FROM {conversations}"
LOG = f"{_LOG} UNION ALL SELECT project, title, content || chr(10) || 'again', kind, agent, created, 2 FROM ({_LOG}) AS x WHERE title LIKE 't%5-%'"
#: Words are functions or classes of each project, by item.
_WORDS = "SELECT item_id, {words} AS name FROM {benchmark}"
ENTITIES = "SELECT DISTINCT 'p' || CAST(item_id % 3 AS VARCHAR(20)) AS project, name || ':' || CAST(item_id AS VARCHAR(20)) AS id, CASE WHEN item_id % 2 = 0 THEN 'Function' ELSE 'Class' END AS kind, name FROM (" + _WORDS + ") AS w"
_SPARK = ENTITIES.format(words="explode(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*', 0))", benchmark="{benchmark}")
_DUCK = ENTITIES.format(words="unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*'))", benchmark="benchmark")
_LAST = f"log AS ({LOG.format(conversations='conversations')}), last AS MATERIALIZED (SELECT sha256(CAST(length(project) AS VARCHAR) || ':' || project || ':' || title) AS id, project, title, content, agent, created FROM log QUALIFY row_number() OVER (PARTITION BY project, title ORDER BY seq DESC, content DESC) = 1), known AS (SELECT * FROM ({_DUCK}) WHERE strlen(name) >= 4 QUALIFY row_number() OVER (PARTITION BY project, name ORDER BY kind <> 'Function', id) <= 5), words AS (SELECT DISTINCT id, project, unnest(regexp_extract_all(title || chr(10) || content, '[A-Za-z_][A-Za-z0-9_]*')) AS name FROM last), links AS MATERIALIZED (SELECT w.id, w.project, k.id AS entity, name FROM words w JOIN known k USING (project, name))"
#: Every tenth conversation is archived, the first turns of every fourth are summaries already.
_STATE = f"{_LAST}, mem AS MATERIALIZED (SELECT last.*, title LIKE '%0-%' AS archived, title LIKE '%4-0' AS summed FROM last), olds AS (SELECT m.project, l.entity AS key, max(m.id) AS oid FROM mem m JOIN links l ON l.id = m.id WHERE summed GROUP BY 1, 2), least AS (SELECT l.id, arg_min(entity, (name, entity)) AS key, min(name) AS name FROM links l GROUP BY 1), act AS (SELECT m.*, key, name FROM mem m JOIN least USING (id) WHERE NOT archived AND NOT summed), grp AS MATERIALIZED (SELECT a.project, a.key, count(*) AS n, min(name) AS name, sum(strlen(title) + strlen(content)) AS before, max(oid) AS oid FROM act a LEFT JOIN olds o ON o.project = a.project AND o.key = a.key GROUP BY 1, 2 HAVING count(*) >= 3 OR max(oid) IS NOT NULL), mb AS MATERIALIZED (SELECT a.* FROM act a JOIN grp g ON g.project = a.project AND g.key = a.key), src AS (SELECT project, key, 0 AS rk, created, id, content FROM mb UNION ALL SELECT g.project, g.key, -1, NULL, NULL, m.content FROM grp g JOIN mem m ON m.id = g.oid), ln AS (SELECT * EXCLUDE content, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS i FROM src), fl AS (SELECT *, trim(regexp_replace(lower(line), '[\\t\\n\\x0B\\f\\r \\x{{85}}\\x{{A0}}]+', ' ', 'g')) AS norm FROM ln WHERE norm <> '' QUALIFY row_number() OVER (PARTITION BY project, key, norm ORDER BY rk, created, id, i) = 1), bd AS (SELECT project, key, id, string_agg(rtrim(line, ' ' || chr(9)), chr(10) ORDER BY i) AS body FROM fl WHERE rk = 0 GROUP BY 1, 2, 3), parts AS MATERIALIZED (SELECT mb.project, mb.key, mb.id, '## ' || title || ' (' || agent || ', ' || created || ')' || chr(10) || coalesce(body, '{M.COVERED}') AS text FROM mb LEFT JOIN bd USING (project, key, id) UNION ALL SELECT project, key, NULL, content FROM src WHERE rk = -1)".replace("{{", "{").replace("}}", "}")


def _stored(spark, d):
    log = spark.sql(LOG.format(conversations="{conversations}"), conversations=table(spark, d, "conversations"))
    return M.stored(log, spark.sql(_SPARK, benchmark=table(spark, d, "benchmark")))


def _folded(spark, d):
    old = F.col("title").like("%4-0")
    m = _stored(spark, d).withColumn("archived", F.col("title").like("%0-%")).withColumn("kind", F.when(old, M.FOLDED).otherwise(F.col("kind")))
    return M.compacted(m.withColumn("member_ids", F.array().cast("array<string>")), 3)


@query("memory_store", f"WITH {_LAST} SELECT id, title, md5(content) AS digest, (SELECT count(*) FROM links l WHERE l.id = last.id) AS n_links, coalesce((SELECT md5(string_agg(entity, ',' ORDER BY entity)) FROM links l WHERE l.id = last.id), md5('')) AS linked FROM last")
def memory_store(spark, d):
    return _stored(spark, d).select("id", "title", F.md5(F.col("content").cast("binary")).alias("digest"), F.size("entity_ids").cast("long").alias("n_links"), F.md5(F.array_join(F.array_sort("entity_ids"), ",").cast("binary")).alias("linked"))


ASKED = "the reason for thanks"
_FIELDS = " UNION ALL ".join(f"SELECT id, unnest({_terms(f)}) AS w, CAST({w} AS DOUBLE) AS fw FROM live" for f, w in M.WEIGHTS.items())


@query("memory_search", f"WITH {_LAST}, live AS (SELECT * FROM last WHERE title NOT LIKE '%0-%'), ws AS ({_FIELDS}), toks AS (SELECT id, {_stem('w')} AS term, fw FROM ws), post AS (SELECT id, term, sum(fw) AS tf, count(*) AS n FROM toks GROUP BY id, term), qw AS (SELECT unnest({_terms(repr(ASKED))}) AS w), q AS (SELECT DISTINCT {_stem('w')} AS term FROM qw), {BM25.format(source='live')}" + TOP.format(t="bm"))
def memory_search(spark, d):
    return M.find(_stored(spark, d).withColumn("archived", F.col("title").like("%0-%")), ASKED, 20)


@query("memory_compact_parts", f"WITH {_STATE} SELECT project, key, id, md5(text) AS digest FROM parts")
def memory_compact_parts(spark, d):
    return _folded(spark, d).parts.select("project", "key", "id", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("memory_compact", f"WITH {_STATE}, af AS (SELECT project, sum(n) AS chars_after FROM (SELECT project, key, sum(strlen(text) + 2) - 2 AS n FROM parts GROUP BY 1, 2) GROUP BY 1) SELECT project, count(*) AS summaries_updated, sum(n) AS memories_archived, sum(before) AS chars_before, max(chars_after) AS chars_after, TRUE AS lossless FROM grp JOIN af USING (project) GROUP BY project")
def memory_compact(spark, d):
    return _folded(spark, d).report
