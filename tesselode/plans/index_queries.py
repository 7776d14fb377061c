"""Two walks over source files built from the documents, the second with changed, new and missing files."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.operators import indexing as I
from tesselode.sources.tables import table

from .catalog import query

_N = "CAST({} AS VARCHAR(20))"
_PATH = f"'src/' || source || '/m' || {_N.format('doc_id')} || '.py'"
#: Three functions a file: one name of its own, one that some files share, one that most do; calls to each sort.
_CODE = f"'# ' || replace(text, chr(10), chr(10) || '# ') || chr(10) || 'def own{{}}(x):' || chr(10) || '    part' || {_N.format('doc_id % 211')} || '()' || chr(10) || '    setup()' || chr(10) || '    own' || {_N.format('doc_id + 1')} || '()' || chr(10) || 'def part' || {_N.format('doc_id % 401')} || '():' || chr(10) || '    own' || {_N.format('doc_id * 2')} || '()' || chr(10) || 'def setup(a):' || chr(10) || '    nobody()' || chr(10)"
_FIRST = _CODE.replace("{}", f"' || {_N.format('doc_id')} || '")
#: In the second walk every tenth file is missing, every tenth has its own function renamed, every tenth has a copy at a new path.
_SECOND = _CODE.replace("{}", f"' || CASE WHEN doc_id % 10 = 1 THEN 'new' ELSE '' END || {_N.format('doc_id')} || '")
WALK1 = f"SELECT {_PATH} AS path, {_FIRST} AS content FROM {{documents}}"
WALK2 = f"SELECT {_PATH} AS path, {_SECOND} AS content FROM {{documents}} WHERE doc_id % 10 <> 0 UNION ALL SELECT 'new/' || {_PATH}, {_SECOND} FROM {{documents}} WHERE doc_id % 10 = 2"
#: Edges that someone drew by hand between files: those whose ends stay outlive the second walk.
_SYMBOL_ID = "CAST(length({p}) AS VARCHAR(20)) || ':' || {p} || CAST(length({n}) AS VARCHAR(20)) || ':' || {n}"
_OWN, _NEXT = f"'own' || {_N.format('doc_id')}", f"'part' || {_N.format('doc_id % 401')}"
MANUAL = f"SELECT 'hand' || {_N.format('doc_id')} AS id, 'CALLS' AS kind, {_SYMBOL_ID.format(p=_PATH, n=_OWN)} AS from_id, {_SYMBOL_ID.format(p=_PATH, n=_NEXT)} AS to_id, 'manual' AS source, CAST(1 AS DOUBLE) AS confidence FROM {{documents}} WHERE doc_id % 3 = 0"


def _passes(spark, d):
    docs = table(spark, d, "documents")
    first = I.reindex(I.State.empty(spark), spark.sql(WALK1, documents=docs), I.definitions, limit=10**9)
    drawn = first.state.edges.unionByName(spark.sql(MANUAL, documents=docs))
    second = I.reindex(I.State(first.state.files, first.state.symbols, drawn), spark.sql(WALK2, documents=docs), I.definitions, limit=10**9)
    return first, second


def _symbols(w: str, walk: str) -> str:
    return f"{w}f_ AS MATERIALIZED (SELECT path, min(coalesce(content, '')) AS content FROM ({walk.format(documents='documents')}) WHERE path IS NOT NULL GROUP BY path), {w}p AS (SELECT path, unnest(string_split(chr(10) || content, chr(10) || 'def ')[2:]) AS part FROM {w}f_), {w}s AS MATERIALIZED (SELECT *, {_SYMBOL_ID.format(p='path', n='name')} AS id, regexp_extract_all(part, chr(10) || ' +([A-Za-z_]\\w*)\\(\\)', 1) AS calls FROM (SELECT *, regexp_extract(part, '^([A-Za-z_]\\w*)\\(', 1) AS name FROM {w}p) WHERE name <> '')"


def _calls(w: str) -> str:
    return f"{w}w AS MATERIALIZED (SELECT DISTINCT id, path, unnest(calls) AS call FROM {w}s), {w}n AS (SELECT w.id, w.call, t.id AS to_id FROM {w}w w JOIN {w}s t ON t.name = w.call AND t.path = w.path), {w}k AS MATERIALIZED (SELECT name, count(*) AS n FROM {w}s GROUP BY name HAVING count(*) <= 3), {w}r AS (SELECT w.id, w.call, t.id AS to_id, k.n FROM {w}w w JOIN {w}k k ON k.name = w.call JOIN {w}s t ON t.name = w.call WHERE NOT EXISTS (SELECT 1 FROM {w}n x WHERE x.id = w.id AND x.call = w.call)), {w}e AS MATERIALIZED (SELECT from_id, to_id, max(c) AS confidence FROM (SELECT id AS from_id, to_id, 0.9 AS c FROM {w}n UNION ALL SELECT id, to_id, CASE WHEN n = 1 THEN 0.8 ELSE 0.5 END FROM {w}r) WHERE from_id <> to_id GROUP BY 1, 2)"


SQL = f"WITH {_symbols('u', WALK1)}, {_symbols('b', WALK2)}"
FATE = "ff AS (SELECT coalesce(a.path, b.path) AS path, CASE WHEN a.path IS NULL THEN 'added' WHEN b.path IS NULL THEN 'vanished' WHEN a.content = b.content THEN 'same' ELSE 'changed' END AS status FROM uf_ a FULL JOIN bf_ b ON b.path = a.path)"
SFATE = "sf AS MATERIALIZED (SELECT coalesce(a.id, b.id) AS id, coalesce(b.path, a.path) AS path, CASE WHEN b.id IS NULL THEN 'gone' WHEN a.id IS NULL THEN 'new' WHEN f.status = 'changed' THEN 'again' ELSE 'same' END AS status FROM us a FULL JOIN bs b ON b.id = a.id LEFT JOIN ff f ON f.path = b.path)"
LINKS = f"hand AS MATERIALIZED ({MANUAL.format(documents='documents')}), alive AS MATERIALIZED (SELECT h.*, x.id IS NOT NULL AND y.id IS NOT NULL AS alive FROM hand h LEFT JOIN bs x ON x.id = h.from_id LEFT JOIN bs y ON y.id = h.to_id), asked AS (SELECT e.* FROM be e WHERE NOT EXISTS (SELECT 1 FROM alive h WHERE h.alive AND h.from_id = e.from_id AND h.to_id = e.to_id)), links AS MATERIALIZED (SELECT kind, from_id, to_id, source, confidence, CASE WHEN alive THEN 'kept' ELSE 'gone' END AS status FROM alive UNION ALL SELECT 'CALLS', coalesce(o.from_id, n.from_id), coalesce(o.to_id, n.to_id), 'resolver', CAST(coalesce(o.confidence, n.confidence) AS DOUBLE), CASE WHEN o.from_id IS NULL THEN 'new' WHEN n.from_id IS NULL THEN 'gone' ELSE 'kept' END FROM ue o FULL JOIN asked n ON n.from_id = o.from_id AND n.to_id = o.to_id)"
_BOTH = f"{SQL}, {FATE}, {SFATE}, {_calls('u')}, {_calls('b')}, {LINKS}"


@query("index_files_second", f"{SQL}, {FATE} SELECT path, status FROM ff")
def index_files_second(spark, d):
    return _passes(spark, d)[1].files.select("path", "status")


@query("index_symbols_second", f"{SQL}, {FATE}, {SFATE} SELECT id, path, status FROM sf")
def index_symbols_second(spark, d):
    return _passes(spark, d)[1].symbols


@query("index_edges_second", f"{_BOTH} SELECT * FROM links")
def index_edges_second(spark, d):
    return _passes(spark, d)[1].edges.drop("id")


@query("index_affected", f"{_BOTH}, touched AS MATERIALIZED (SELECT id FROM sf WHERE status <> 'same'), around AS (SELECT from_id, to_id FROM ue UNION ALL SELECT from_id, to_id FROM hand UNION ALL SELECT from_id, to_id FROM links WHERE status = 'new') SELECT id FROM touched UNION SELECT from_id FROM around WHERE to_id IN (SELECT id FROM touched)")
def index_affected(spark, d):
    return _passes(spark, d)[1].affected


def _report(files: str, symbols: str, links: str) -> str:
    n = lambda t, c: f"(SELECT count(*) FROM {t} WHERE {c})"
    return f"SELECT {n(files, chr(39) + 'vanished' + chr(39) + ' <> status')} AS files_seen, {n(files, 'status IN (' + repr('added') + ', ' + repr('changed') + ')')} AS files_changed, {n(files, 'status = ' + repr('vanished'))} AS files_deleted, {n(symbols, 'status <> ' + repr('gone'))} AS functions, {n(symbols, 'status = ' + repr('gone'))} AS symbols_removed, {n(links, 'status = ' + repr('new'))} AS edges_added, {n(links, 'status = ' + repr('gone'))} AS edges_removed, FALSE AS truncated"


@query("index_report", f"{_BOTH} SELECT 1 AS walk, (SELECT count(*) FROM uf_) AS files_seen, (SELECT count(*) FROM uf_) AS files_changed, 0 AS files_deleted, (SELECT count(*) FROM us) AS functions, 0 AS symbols_removed, (SELECT count(*) FROM ue) AS edges_added, 0 AS edges_removed, FALSE AS truncated UNION ALL SELECT 2, * FROM ({_report('ff', 'sf', 'links')})")
def index_report(spark, d):
    first, second = _passes(spark, d)
    return I.report(first).select(F.lit(1).alias("walk"), "*").unionByName(I.report(second).select(F.lit(2).alias("walk"), "*"))
