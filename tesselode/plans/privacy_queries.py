"""Names of the benchmark items under numbered tokens, replaced in all documents, and the ladder over texts with something to hide."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.functions import text_rules as R
from tesselode.operators import privacy as P
from tesselode.sources.tables import table

from .catalog import query

#: A sighting for each word of five letters or more: long words are classes, the others functions or variables.
SIGHTINGS = "SELECT word AS name, CASE WHEN length(word) > 9 THEN 'CLASS' WHEN length(word) % 2 = 0 THEN 'FUNC' ELSE 'VAR' END AS kind, item_id AS seen FROM (SELECT item_id, {words} AS word FROM {benchmark}) WHERE length(word) > 4"
_SPARK = SIGHTINGS.format(words="explode(split(lower(text), '[^a-z]+'))", benchmark="{benchmark}")
_DUCK = SIGHTINGS.format(words="unnest(regexp_split_to_array(lower(text), '[^a-z]+'))", benchmark="benchmark")
TOKENS = f"seen AS ({_DUCK}), first AS (SELECT name, min(seen) AS seen, arg_min(kind, seen) AS kind FROM seen GROUP BY name), tokens AS MATERIALIZED (SELECT name, kind, kind || '_' || CAST(row_number() OVER (PARTITION BY kind ORDER BY seen, name) AS VARCHAR) AS token FROM first)"
#: Names in the order they are replaced. Tokens are in capitals and names are not, so no name is found in a token.
ORDERED = "ordered AS MATERIALIZED (SELECT list(name || chr(1) || token ORDER BY strlen(name) DESC, name) AS all_names FROM tokens)"
_FOLD = "list_reduce([{x}] || all_names, lambda t, n: replace(t, split_part(n, chr(1), 1), split_part(n, chr(1), 2)))"


def _tokens(spark, d):
    return P.numbered(spark.sql(_SPARK, benchmark=table(spark, d, "benchmark")))


@query("pseudonym_tokens", f"WITH {TOKENS} SELECT name, kind, token FROM tokens")
def pseudonym_tokens(spark, d):
    return _tokens(spark, d)


@query("pseudonymize_texts", f"WITH {TOKENS}, {ORDERED}, r AS (SELECT doc_id, {_FOLD.format(x='text')} AS t FROM documents, ordered) SELECT doc_id, length(t) AS n_chars, md5(t) AS digest FROM r")
def pseudonymize_texts(spark, d):
    r = P.replaced(table(spark, d, "documents").select("doc_id", "text"), _tokens(spark, d))
    return r.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))


_TEXT = "CASE doc_id % 6 WHEN 0 THEN text || ' password = hunter2hunter' WHEN 1 THEN text || ' see /home/me/x.py and \"/etc/hosts\"' WHEN 2 THEN '/vault/a ' || text WHEN 3 THEN text || ' launchCode' WHEN 4 THEN '/srv/open/b.py ' || text ELSE text END"
POLICY = P.Policy(mode="MASKED", forbidden_identifiers=["launchCode"], forbidden_paths=["/vault/"], allowed_paths=["/srv/open/"], max_words=120)
_SECRET = " OR ".join("regexp_matches(t, '" + p.replace("'", "''") + "')" for _, p in R.SECRETS)
_BLANKS = "[\\t\\n\\x0B\\f\\r ]+"
_REDACTED = "t"
for _kind, _p in R.SECRETS:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_p.replace(chr(39), chr(39) * 2)}', '{chr(92) + '1' if _kind in R.KEYED else ''}{R.MARK}', 'g')"
_LADDER = f"s AS (SELECT doc_id, {_TEXT} AS t FROM documents), v AS (SELECT *, CASE WHEN {_SECRET} THEN 'secret' WHEN contains(t, 'launchCode') THEN 'identifier' WHEN starts_with(t, '/vault/') THEN 'path' ELSE '' END AS stop, CASE WHEN starts_with(t, '/srv/open/') THEN t ELSE regexp_replace(t, '{P.PATHS.replace(chr(39), chr(39) * 2)}', '***PATH***', 'g') END AS clean FROM s)"
_MASKED = f"m AS (SELECT *, {_FOLD.format(x='clean')} AS masked FROM v, ordered), w AS (SELECT *, list_filter(regexp_split_to_array(masked, '{_BLANKS}'), lambda x: x <> '') AS words FROM m), o AS (SELECT *, CASE stop WHEN 'secret' THEN {_REDACTED} WHEN 'identifier' THEN '***FORBIDDEN_IDENTIFIER***' WHEN 'path' THEN '***FORBIDDEN_PATH***' ELSE CASE WHEN len(words) > {POLICY.max_words} THEN array_to_string(words[:{POLICY.max_words}], ' ') || '...' ELSE masked END END AS sanitized FROM w)"
_WHY = f"CASE stop WHEN 'secret' THEN 'secret detected' WHEN 'identifier' THEN 'forbidden identifier present' WHEN 'path' THEN 'forbidden path present' ELSE concat_ws(',', CASE WHEN clean <> t THEN 'path not allowed' END, CASE WHEN len(words) > {POLICY.max_words} THEN 'max context tokens exceeded' END) END"


@query("sanitize_context", f"WITH {TOKENS}, {ORDERED}, {_LADDER}, {_MASKED} SELECT doc_id, stop = '' AS allowed, {_WHY} AS reasons, length(sanitized) AS n_chars, md5(sanitized) AS digest FROM o")
def sanitize_context(spark, d):
    docs = table(spark, d, "documents").selectExpr("doc_id", f"{_TEXT} AS text")
    out = P.sanitized(docs, POLICY, _tokens(spark, d))
    return out.select("doc_id", "allowed", F.array_join("reasons", ",").alias("reasons"), F.length("sanitized").cast("long").alias("n_chars"), F.md5(F.col("sanitized").cast("binary")).alias("digest"))
