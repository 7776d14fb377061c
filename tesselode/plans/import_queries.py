"""Source files of five languages built from the documents: what their imports mean, which are dead, which files a machine wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.operators import imports as I
from tesselode.sources.tables import table

from .catalog import query

MODULE = "example.org/mod"


def _n(x: str) -> str:
    return f"CAST({x} AS VARCHAR(20))"


#: Path by language: Python, scripts, Java, Go, C. Java names and Go folders are shared by more files as there are more documents.
PATH = f"CASE doc_id % 5 WHEN 0 THEN 'src/pk' || {_n('doc_id % 50')} || CASE WHEN doc_id % 3 = 0 THEN '/q' || {_n('doc_id')} || '/__init__.py' ELSE '/m' || {_n('doc_id')} || '.py' END WHEN 1 THEN 'web/a' || {_n('doc_id % 10')} || CASE doc_id % 3 WHEN 0 THEN '/x' || {_n('doc_id')} || '/index.tsx' WHEN 1 THEN '/f' || {_n('doc_id')} || '.ts' ELSE '/f' || {_n('doc_id')} || '.jsx' END WHEN 2 THEN 'jv/d' || {_n('doc_id')} || '/com/acme/' || CASE WHEN doc_id % 3 = 0 THEN 'D' || {_n('doc_id')} ELSE 'C' || {_n('doc_id % 35')} END || '.java' WHEN 3 THEN 'go/svc' || {_n('doc_id % 2')} || '/pkg' || {_n('doc_id % 4')} || '/g' || {_n('doc_id')} || CASE WHEN doc_id % 3 = 0 THEN '_test.go' ELSE '.go' END ELSE 'c/inc' || {_n('doc_id % 3')} || '/h' || {_n('doc_id')} || '.h' END"
#: (rest of doc_id, target) of each import; every one is used below its line by some files only.
TARGETS = [
    (0, f"'pk' || {_n('(doc_id + 5) % 50')} || '.m' || {_n('doc_id + 5')}"), (0, f"'pk' || {_n('(doc_id + 5) % 50')} || '.q' || {_n('doc_id + 5')}"), (0, f"'.m' || {_n('doc_id + 50')}"), (0, f"'..pk' || {_n('(doc_id + 5) % 50')} || '.q' || {_n('doc_id + 5')}"), (0, "'os'"),
    (1, f"'./f' || {_n('doc_id + 10')}"), (1, f"'../a' || {_n('(doc_id + 5) % 10')} || '/f' || {_n('doc_id + 5')} || '.js'"), (1, f"'./x' || {_n('doc_id + 10')}"), (1, "'react'"),
    (2, f"'com.acme.D' || {_n('doc_id + 15')}"), (2, f"'com.acme.C' || {_n('doc_id % 35')}"), (2, "'com.acme.*'"),
    (3, f"'{MODULE}/svc' || {_n('doc_id % 2')} || '/pkg' || {_n('(doc_id + 2) % 4')}"), (3, f"'other/svc' || {_n('(doc_id + 1) % 2')} || '/pkg' || {_n('(doc_id + 1) % 4')}"), (3, "'fmt'"),
    (4, f"'h' || {_n('doc_id + 15')} || '.h'"), (4, f"'inc' || {_n('(doc_id + 5) % 3')} || '/h' || {_n('doc_id + 5')} || '.h'"), (4, "'stdio.h'"),
]
_FORMS = {0: "'import ' || {t}", 1: "'import y from \"' || {t} || '\"'", 2: "'import ' || {t} || ';'", 3: "'import \"' || {t} || '\"'", 4: "'#include <' || {t} || '>'"}
_HEAD = "CASE doc_id % 5 WHEN 0 THEN '# ' WHEN 1 THEN '// ' WHEN 2 THEN '// ' WHEN 3 THEN '// ' ELSE '// ' END"
_BODY = "CASE doc_id % 5 " + " ".join(f"WHEN {k} THEN " + " || chr(10) || ".join(form.format(t=t) if not (k == 0 and t.startswith("'.")) else f"'from ' || {t} || ' import z'" for r, t in TARGETS if r == k) for k, form in _FORMS.items()) + " END"
_USES = f"CASE WHEN doc_id % 2 = 0 THEN 'os react fmt m' || {_n('doc_id + 5')} || ' h' || {_n('doc_id + 15')} ELSE '' END"
FILES = f"SELECT doc_id, {PATH} AS path, {_BODY} || chr(10) || {_USES} || chr(10) || {_HEAD} || replace(text, chr(10), ' ') AS content FROM {{documents}}"
_D = FILES.format(documents="documents")
_I = "i AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(path, '^(.*)/[^/]*/[^/]*$', 1) AS up, doc_id % 5 AS k, {t} AS target FROM f WHERE doc_id % 5 = {k}" for k, t in TARGETS) + ")"
#: Plain rules over every pair of an import and a path, for the forms above.
_PY = "py AS (SELECT path, target, p, ends_with(p, '/' || rel || '.py') AS mod, count(*) FILTER (ends_with(p, '/' || rel || '.py')) OVER w AS n_mod, count(*) OVER w AS n FROM (SELECT i.*, replace(target, '.', '/') AS rel FROM i WHERE k = 0 AND target NOT LIKE '.%') JOIN (SELECT path AS p FROM f WHERE doc_id % 5 = 0) ON ends_with(p, '/' || rel || '.py') OR ends_with(p, '/' || rel || '/__init__.py') WINDOW w AS (PARTITION BY path, target))"
_EXACT = "e AS (SELECT path, CASE WHEN k = 0 AND target LIKE '..%' THEN up || '/' || replace(target[3:], '.', '/') WHEN k = 0 THEN dir || '/' || target[2:] WHEN target LIKE '../%' THEN up || '/' || regexp_replace(target[4:], '\\.js$', '') WHEN k = 1 THEN dir || target[2:] ELSE dir || '/' || target END AS base, k FROM i WHERE target LIKE '.%' OR k = 4), ex AS (SELECT e.path, f.path AS p FROM e JOIN f ON f.path IN (base || '.py', base || '/__init__.py', base || '.ts', base || '.tsx', base || '.js', base || '.jsx', base || '/index.ts', base || '/index.tsx') AND k < 4 OR f.path = base AND k = 4)"
_ENDS = "je AS (SELECT i.path, i.target, min(f.path) AS p, count(*) AS n FROM i JOIN f ON ends_with(f.path, '/' || CASE WHEN k = 2 THEN replace(target, '.', '/') || '.java' ELSE target END) AND f.doc_id % 5 = k WHERE k IN (2, 4) GROUP BY 1, 2)"
_GO = f"gf AS (SELECT path AS p, regexp_extract(path, '^(.*)/[^/]*$', 1) AS d FROM f WHERE path LIKE '%.go' AND NOT ends_with(path, '_test.go')), gd AS (SELECT DISTINCT target FROM i WHERE k = 3), gh AS (SELECT target, p FROM gd JOIN gf ON CASE WHEN starts_with(target, '{MODULE}/') THEN d = 'go/' || target[{len(MODULE) + 2}:] ELSE ends_with(d, '/' || regexp_extract(target, '([^/]*/)?[^/]*$', 0)) END QUALIFY row_number() OVER (PARTITION BY target ORDER BY p) <= 20)"


@query("resolve_imports", f"WITH f AS MATERIALIZED ({_D}), {_I}, {_PY}, {_EXACT}, {_ENDS}, {_GO}, hit AS (SELECT path, p FROM py WHERE CASE WHEN mod THEN n_mod = 1 ELSE n_mod <> 1 AND n - n_mod = 1 END UNION ALL SELECT path, p FROM ex UNION ALL SELECT path, p FROM je WHERE n = 1 UNION ALL SELECT path, p FROM i JOIN gh USING (target) WHERE k = 3) SELECT DISTINCT path AS from_path, p AS to_path, CAST(0.9 AS DOUBLE) AS confidence FROM hit WHERE p <> path")
def resolve_imports(spark, d):
    files = spark.sql(FILES, documents=table(spark, d, "documents")).select("path", "content")
    return I.resolved(I.imports_of(files), files, MODULE, "go")


@query("dead_imports", f"WITH f AS MATERIALIZED ({_D}), {_I}, s AS (SELECT DISTINCT path AS source, target AS module, list_last(string_split(list_last(string_split(target, '.')), '/')) AS short FROM i) SELECT source, module FROM s JOIN f ON f.path = source WHERE short NOT IN ('', '*') AND len(regexp_extract_all(content, '\\b' || short || '\\b')) <= 1 UNION SELECT source, module FROM s JOIN f ON f.path = source WHERE short = '*' AND len(regexp_extract_all(content, '\\b\\*\\b')) <= 1")
def dead_imports(spark, d):
    files = spark.sql(FILES, documents=table(spark, d, "documents")).select("path", "content")
    return I.dead_imports(files, I.imports_of(files))


_MARKED = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'a/x' || CAST(doc_id AS VARCHAR(20)) || '_pb2.py' ELSE 'a/y.py' END AS path, CASE doc_id % 3 WHEN 0 THEN '// Code generated by a tool. DO NOT EDIT.' || chr(10) || text WHEN 1 THEN repeat(chr(10), 25) || 'automatically generated' || chr(10) || text ELSE text END AS content FROM {documents}"


@query("generated_files", f"SELECT doc_id, regexp_matches(path, '{I.GENERATED_NAME}') OR regexp_matches(array_to_string(string_split(content, chr(10))[:20], chr(10)), '{I.GENERATED}') AS is_generated FROM ({_MARKED.format(documents='documents')})")
def generated_files(spark, d):
    x = spark.sql(_MARKED, documents=table(spark, d, "documents"))
    return x.select("doc_id", I.generated(F.col("path"), F.col("content")).alias("is_generated"))
