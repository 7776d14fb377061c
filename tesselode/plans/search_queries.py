"""Retrieval, text-rule and extraction queries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tesselode.functions import text_rules as R
from tesselode.operators import search as S
from tesselode.sources.tables import table

from .catalog import query

TEXT = "the reason of things"


def _stem(w: str) -> str:
    n = f"octet_length(encode({w}))"
    return f"CASE WHEN {n} > 4 AND {w} LIKE '%ies' THEN left({w}, length({w}) - 3) || 'y' WHEN {n} > 4 AND {w} LIKE '%es' AND NOT {w} LIKE '%ses' THEN left({w}, length({w}) - 2) WHEN {n} > 3 AND {w} LIKE '%s' AND NOT {w} LIKE '%ss' THEN left({w}, length({w}) - 1) ELSE {w} END"


def _cut(text: str) -> str:
    """Words apart by blanks, their parts by chr(1)."""
    out = f"regexp_replace({text}, '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g')"
    for pattern in ("(\\p{Lu})(\\p{Lu}\\p{Ll})", "(\\p{Ll})(\\p{Lu})", "(\\p{L})(\\p{Nd})", "(\\p{Nd})(\\p{L})"):
        out = f"regexp_replace({out}, '{pattern}', '\\1' || chr(1) || '\\2', 'g')"
    return out


def _terms(text: str) -> str:
    words = f"list_filter(string_split({_cut(text)}, ' '), lambda w: w <> '')"
    return f"list_transform(flatten(list_transform({words}, lambda w: CASE WHEN contains(w, chr(1)) THEN list_concat([replace(w, chr(1), '')], string_split(w, chr(1))) ELSE [w] END)), lambda w: lower(w))"


def _tok(source: str, key: str, fields: dict[str, float]) -> str:
    parts = [f"SELECT {key} AS id, unnest({_terms(f)}) AS w, CAST({x} AS DOUBLE) AS fw FROM {source}" for f, x in fields.items()]
    asked = TEXT if source == "documents" else PART_TEXT
    return f"words AS ({' UNION ALL '.join(parts)}), toks AS (SELECT id, {_stem('w')} AS term, fw FROM words), post AS (SELECT id, term, sum(fw) AS tf, count(*) AS n FROM toks GROUP BY id, term), qw AS (SELECT unnest({_terms(repr(asked))}) AS w), q AS (SELECT {_stem('w')} AS term, count(*) AS qn FROM qw GROUP BY 1)"


PART_TEXT = "cold steel"
BM25 = "size AS (SELECT id, sum(tf) AS len FROM post GROUP BY id), st AS (SELECT (SELECT count(*) FROM {source}) AS n, (SELECT sum(len) FROM size) AS total), df AS (SELECT term, count(*) AS df FROM post GROUP BY term), bm AS (SELECT p.id, sum(ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * size.len / (st.total / st.n)))) AS score FROM post p JOIN q ON p.term = q.term JOIN df ON df.term = p.term JOIN size ON size.id = p.id CROSS JOIN st GROUP BY p.id)"
COS = "nrm AS (SELECT id, sqrt(sum(n * n)) AS norm FROM post GROUP BY id), cs AS (SELECT p.id, sum(p.n * q.qn) / (max(nrm.norm) * (SELECT sqrt(sum(qn * qn)) FROM q)) AS score FROM post p JOIN q ON p.term = q.term JOIN nrm ON nrm.id = p.id GROUP BY p.id)"
TOP = " SELECT id, round(score, 6) AS score FROM {t} WHERE score > 0 ORDER BY 2 DESC, 1 LIMIT 20"


def _docs(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


@query("bm25_docs", f"WITH {_tok('documents', 'doc_id', {'text': 1})}, {BM25.format(source='documents')}" + TOP.format(t="bm"))
def bm25_docs(spark, d):
    terms = S.query_terms(spark, TEXT)
    return S.top(S.bm25_of(S.measured(_docs(spark, d), {"text": 1}, list(terms)), list(terms)), 20)


@query("bm25_fields", f"WITH {_tok('part', 'p_partkey', {'p_name': 3, 'p_brand': 1.5, 'p_type': 1})}, {BM25.format(source='part')}" + TOP.format(t="bm"))
def bm25_fields(spark, d):
    docs = table(spark, d, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", "p_type")
    terms = list(S.query_terms(spark, PART_TEXT))
    return S.top(S.bm25_of(S.measured(docs, {"p_name": 3, "p_brand": 1.5, "p_type": 1}, terms), terms), 20)


@query("tf_cosine_docs", f"WITH {_tok('documents', 'doc_id', {'text': 1})}, {COS}" + TOP.format(t="cs"))
def tf_cosine_docs(spark, d):
    terms = S.query_terms(spark, TEXT)
    return S.top(S.cosine_of(S.measured(_docs(spark, d), {"text": 1}, list(terms)), terms), 20)


@query("rrf_hybrid", f"WITH {_tok('documents', 'doc_id', {'text': 1})}, {BM25.format(source='documents')}, {COS}, parts AS (SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) AS p FROM bm UNION ALL SELECT id, 1.0 / (60 + row_number() OVER (ORDER BY round(score, 9) DESC, id)) FROM cs), fused AS (SELECT id, sum(p) AS score FROM parts GROUP BY id)" + TOP.format(t="fused"))
def rrf_hybrid(spark, d):
    terms = S.query_terms(spark, TEXT)
    figures = S.measured(_docs(spark, d), {"text": 1}, list(terms))
    return S.top(S.fuse(S.bm25_of(figures, list(terms)), S.cosine_of(figures, terms)), 20)


@query("search_fallback", "SELECT doc_id AS id, CAST(0 AS DOUBLE) AS score FROM documents WHERE contains(lower(text), 'licensed under') ORDER BY id LIMIT 20")
def search_fallback(spark, d):
    docs = _docs(spark, d)
    terms = list(S.query_terms(spark, "qqzzxx"))
    return S.with_fallback(S.bm25_of(S.measured(docs, {"text": 1}, terms), terms), docs, "text", "licensed under", 20)


@query("vector_knn", "WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 7) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE) * CAST(e[i] AS DOUBLE))) / sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) * list_sum(list_transform(e, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 5) AS cosine FROM embeddings CROSS JOIN q WHERE vec_id <> 7 ORDER BY cosine DESC, vec_id LIMIT 10")
def vector_knn(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    q = F.broadcast(v.where("vec_id = 7").select(F.col("x").alias("q")))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda s, t: s * t), F.lit(0.0), lambda s, t: s + t)
    cosine = dot(F.col("x"), F.col("q")) / F.sqrt(dot(F.col("x"), F.col("x")) * dot(F.col("q"), F.col("q")))
    return v.where("vec_id <> 7").crossJoin(q).select("vec_id", F.round(cosine, 5).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(10)  # one query row


@query("did_you_mean", "SELECT DISTINCT p_type AS suggestion, levenshtein(p_type, 'STANDARD TIN') AS distance FROM part WHERE 4 * levenshtein(p_type, 'STANDARD TIN') <= 24 ORDER BY distance, suggestion LIMIT 3")
def did_you_mean(spark, d):
    x = table(spark, d, "part").select(F.col("p_type").alias("suggestion")).distinct().withColumn("distance", F.levenshtein("suggestion", F.lit("STANDARD TIN")))
    return x.where("4 * distance <= 24").orderBy("distance", "suggestion").limit(3)


_ID = "CAST(doc_id AS VARCHAR(20))"
SECRET_TEXT = f"CASE doc_id % 9 WHEN 0 THEN text || ' API-Key: ABCD1234efgh5678' || {_ID} WHEN 1 THEN text || ' password = hunter2hunter' || {_ID} WHEN 2 THEN text || ' token=abcdefgh.12345678-' || {_ID} WHEN 3 THEN text || ' -----BEGIN RSA PRIVATE KEY-----' WHEN 4 THEN text || ' aws_secret_access_key=' || repeat('A1b2', 10) WHEN 5 THEN text || ' postgres://u:p@h/db' || {_ID} WHEN 6 THEN text || ' eyJabcdefghij.klmnopqrst.uvwxyz1234' || {_ID} WHEN 7 THEN text || ' ghp_' || repeat('a1B2', 6) || {_ID} ELSE text END"


def _secret_docs(spark, d):
    return table(spark, d, "documents").selectExpr("doc_id", f"{SECRET_TEXT} AS t")


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _redacted(x: str) -> str:
    for kind, p in R.SECRET_PATTERNS:
        x = f"regexp_replace({x}, {_quoted(p)}, '{chr(92) + '1' if kind in R.KEYED else ''}{R.MARK}', 'g')"
    return x


@query("redact_secrets", f"WITH s AS (SELECT doc_id, {SECRET_TEXT} AS t FROM documents) SELECT doc_id, length({_redacted('t')}) AS n_chars, md5({_redacted('t')}) AS digest FROM s")
def redact_secrets(spark, d):
    r = R.redact(F.col("t"))
    return _secret_docs(spark, d).select("doc_id", F.length(r).cast("long").alias("n_chars"), F.md5(r.cast("binary")).alias("digest"))


@query("security_scan", "WITH s AS (SELECT doc_id, " + SECRET_TEXT + " AS t FROM documents) " + " UNION ALL ".join(f"SELECT doc_id, '{k}' AS rule, length(split_part(t, regexp_extract(t, {_quoted(p)}), 1)) - length(replace(split_part(t, regexp_extract(t, {_quoted(p)}), 1), chr(10), '')) + 1 AS line FROM s WHERE regexp_matches(t, {_quoted(p)})" for k, p in R.SECRET_PATTERNS))
def security_scan(spark, d):
    return _secret_docs(spark, d).select("doc_id", F.explode(R.secret_hits(F.col("t"))).alias("hit")).select("doc_id", "hit.rule", "hit.line")


@query("firewall_verdict", f"WITH s AS (SELECT doc_id, {SECRET_TEXT} AS t FROM documents) SELECT doc_id, CASE WHEN doc_id % 13 = 0 THEN 'local_only' WHEN " + " OR ".join(f"regexp_matches(t, {_quoted(p)})" for _, p in R.SECRET_PATTERNS) + " THEN 'blocked_secret' WHEN contains(t, 'clown') THEN 'blocked_identifier' WHEN length(t) > 5000 THEN 'capped' ELSE 'allowed' END AS verdict FROM s")
def firewall_verdict(spark, d):
    v = F.when(F.col("doc_id") % 13 == 0, "local_only").when(R.secret_kinds(F.col("t")) != "", "blocked_secret").when(F.col("t").contains("clown"), "blocked_identifier").when(F.length("t") > 5000, "capped").otherwise("allowed")
    return _secret_docs(spark, d).select("doc_id", v.alias("verdict"))


CODE = "coalesce(text, '') || CASE doc_id % 4 WHEN 0 THEN ' if (a && b || c) { for (;;) { while (x) {} } }' WHEN 1 THEN ' switch (y) { case 1: case 2: } try {} catch (e) {}' WHEN 2 THEN ' iffy for_each whiles and or' ELSE '' END"


@query("complexity_count", f"SELECT doc_id, 1 + " + " + ".join(f"length(regexp_extract_all(t, '{p}'))" for p in (r"\bif\b", r"\bfor\b", r"\bwhile\b", r"\bcase\b", r"\bcatch\b", r"&&|\|\|")) + f" AS complexity FROM (SELECT doc_id, {CODE} AS t FROM documents)")
def complexity_count(spark, d):
    code = table(spark, d, "documents").selectExpr("doc_id", f"{CODE} AS t")
    return code.select("doc_id", R.complexity(F.col("t")).cast("long").alias("complexity"))


@query("pseudonyms", "WITH f AS (SELECT event_type AS kind, user_id, min(event_id) AS first FROM events GROUP BY 1, 2) SELECT kind, user_id, upper(kind) || '_' || CAST(dense_rank() OVER (PARTITION BY kind ORDER BY first) AS VARCHAR) AS pseudonym FROM f")
def pseudonyms(spark, d):
    f = table(spark, d, "events").groupBy(F.col("event_type").alias("kind"), "user_id").agg(F.min("event_id").alias("first"))
    n = F.dense_rank().over(Window.partitionBy("kind").orderBy("first"))
    return f.select("kind", "user_id", F.concat(F.upper("kind"), F.lit("_"), n.cast("string")).alias("pseudonym"))


MENTION = "WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents), names AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark)"


@query("mentions_link", MENTION + ", hit AS (SELECT w.doc_id, n.item_id, w.word, row_number() OVER (PARTITION BY n.item_id, w.word ORDER BY w.doc_id) AS r FROM w JOIN names n ON w.word = n.word WHERE length(w.word) > 6) SELECT doc_id, item_id, word FROM hit WHERE r <= 5")
def mentions_link(spark, d):
    words = lambda df, k: df.select(k, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).where(F.length("word") > 6).distinct()
    # a word's first documents are the same for every item, so the rank comes before the join
    r = F.row_number().over(Window.partitionBy("word").orderBy("doc_id"))
    first = words(table(spark, d, "documents"), "doc_id").withColumn("r", r).where("r <= 5")
    return first.join(words(table(spark, d, "benchmark"), "item_id"), "word").select("doc_id", "item_id", "word")


@query("doc_refs_missing", "WITH w AS (SELECT DISTINCT item_id, unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM benchmark), known AS (SELECT DISTINCT unnest(regexp_split_to_array(lower(text), '[^a-z]+')) AS word FROM documents) SELECT item_id, count(*) AS missing FROM w WHERE word NOT IN (SELECT word FROM known) GROUP BY item_id")
def doc_refs_missing(spark, d):
    words = lambda df, *k: df.select(*k, F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")).distinct()
    lost = words(table(spark, d, "benchmark"), "item_id").join(words(table(spark, d, "documents")), "word", "left_anti")
    return lost.groupBy("item_id").agg(F.count("*").alias("missing"))


@query("compact_lossless", "WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line FROM conversations), n AS (SELECT conv_id, turn, trim(regexp_replace(lower(line), '[ ]+', ' ', 'g')) AS norm FROM l) SELECT conv_id, count(*) AS n_lines, count(DISTINCT norm) AS kept FROM n WHERE norm <> '' GROUP BY conv_id")
def compact_lossless(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", F.explode(F.split("text", "\n")).alias("line"))
    norm = F.trim(F.regexp_replace(F.lower("line"), "[ ]+", " "))
    return lines.select("conv_id", norm.alias("norm")).where("norm <> ''").groupBy("conv_id").agg(F.count("*").alias("n_lines"), F.count_distinct("norm").alias("kept"))


@query("import_unique_suffix", "WITH u AS (SELECT page_id, regexp_extract(url, '://([^/]+)', 1) AS host, regexp_extract(url, '://[^/]+(/[^?#]*)', 1) AS path FROM pages), b AS (SELECT path, count(*) AS n, min(page_id) AS target FROM u GROUP BY path) SELECT page_id, target, CASE WHEN n = 1 THEN 0.9 ELSE 0.5 END AS confidence FROM u JOIN b USING (path) WHERE n <= 3")
def import_unique_suffix(spark, d):
    u = table(spark, d, "pages").select("page_id", F.regexp_extract("url", r"://[^/]+(/[^?#]*)", 1).alias("path"))
    b = u.groupBy("path").agg(F.count("*").alias("n"), F.min("page_id").alias("target")).where("n <= 3")
    return u.join(b, "path").select("page_id", "target", F.when(F.col("n") == 1, 0.9).otherwise(0.5).alias("confidence"))
