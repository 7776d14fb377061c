"""The training-data operators as queries over the driver's tables; SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collocations import LEAST, TOP, collocations
from .decontaminate import find_leaks
from .fill_middle import fill_in_middle, restore
from .kd_shards import kd_shards
from .minhash_dedup import near_duplicates
from .order_minhash import order_minhash
from .packing import pack
from .rlz_dedup import rlz_dedup
from .suffix_dedup import suffix_dedup
from .token_counts import token_counts
from .toxicity import THRESHOLD, fit, score
from .url_filter import Rule, url_filter
from .warc import round_trip


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_tokens").alias("n_bytes"), "n_removed", "n_spans", "kept_sha256")


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, _table(spark, sf_dir, "labels").where(~held_out()))
    out = score(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_rlz_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rlz_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("n_tokens").alias("n_words"), "n_removed", "kept_sha256")


def op6_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_minhash(_table(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(_table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(_table(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(_table(spark, sf_dir, "documents"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = restore(fill_in_middle(_table(spark, sf_dir, "documents")))
    return out.select("doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"), F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


# The rules of hosts and paths.
URL_RULES = [Rule("org", "/", "allow"), Rule("example.org", "/es/", "block"), Rule("example.org", "/en/1", "block"), Rule("com", "/fr/", "allow"), Rule("com", "/de/", "block")]


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(_table(spark, sf_dir, "pages"), URL_RULES)


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_decontamination, op3_suffix_dedup, op4_toxicity, op5_rlz_dedup, op6_order_minhash, op7_warc, op8_kd_shards, op9_packing, op10_token_counts, op11_collocations, op12_fill_in_middle, op13_url_filter)}

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_PHRASES = " UNION ALL ".join("SELECT lang, {k} AS k, {p} AS p FROM runs WHERE {last} IS NOT NULL".format(k=k, p=" || ' ' || ".join(f"w{j}" for j in range(1, k + 1)), last=f"w{k}") for k in range(1, 5))
_WORDS = "string_split(p, ' ')"
_INNER = " UNION ALL ".join(f"SELECT lang, array_to_string(list_slice({_WORDS}, {i}, {i + m - 1}), ' ') AS p, f FROM cand WHERE k = {k}" for k in (3, 4) for m in range(2, k) for i in range(1, k - m + 2))
_CUTS = " UNION ALL ".join(f"SELECT lang, k, p, f, {j} AS j, array_to_string(list_slice({_WORDS}, 1, {j}), ' ') AS lp, array_to_string(list_slice({_WORDS}, {j + 1}, k), ' ') AS rp FROM kept WHERE k > {j}" for j in (1, 2, 3))
COLLOCATIONS_SQL = f"""
WITH pieces AS (SELECT lang, row_number() OVER () AS piece, t FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\\x0A-\\x0D]')) AS t FROM documents)),
ws AS (SELECT lang, piece, generate_subscripts(w, 1) AS i, unnest(w) AS w FROM (SELECT lang, piece, list_filter(regexp_split_to_array(t, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces)),
runs AS (SELECT lang, w AS w1, lead(w, 1) OVER o AS w2, lead(w, 2) OVER o AS w3, lead(w, 3) OVER o AS w4 FROM ws WINDOW o AS (PARTITION BY piece ORDER BY i)),
grams AS ({_PHRASES}), freq AS (SELECT lang, k, p, CAST(count(*) AS BIGINT) AS f FROM grams GROUP BY ALL HAVING k = 1 OR count(*) >= {LEAST}), total AS (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM freq WHERE k = 1 GROUP BY lang),
cand AS (SELECT * FROM freq WHERE k > 1), longer AS (SELECT lang, p, max(f) AS f FROM ({_INNER}) GROUP BY ALL),
kept AS (SELECT c.* FROM cand c LEFT JOIN longer o ON o.lang = c.lang AND o.p = c.p WHERE o.f IS NULL OR 100 * o.f < 80 * c.f), cuts AS ({_CUTS}),
scored AS (SELECT c.lang, c.p AS phrase, c.f AS a, c.j, l.f AS l, r.f AS r, CAST((CAST(2000000 AS HUGEINT) * c.f) // (l.f + r.f) AS BIGINT) AS score FROM cuts c JOIN freq l ON l.lang = c.lang AND l.p = c.lp JOIN freq r ON r.lang = c.lang AND r.p = c.rp),
loosest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1)
SELECT lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS BIGINT) AS rank, phrase, a, l, r, n, score FROM loosest JOIN total USING (lang) QUALIFY rank <= {TOP}
"""

_NUMBER = "CAST('0x' || substr(h, {}, 8) AS BIGINT)"
FILL_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, CAST(length(coalesce(text, '')) AS BIGINT) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, {_NUMBER.format(1)} % (n + 1) AS x, {_NUMBER.format(9)} % (n + 1) AS y, {_NUMBER.format(17)} % 100 AS p, {_NUMBER.format(25)} % 100 AS s FROM d),
c AS (SELECT *, least(x, y) AS lo, greatest(x, y) AS hi, CASE WHEN n = 0 OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR p >= 90 THEN 'plain' WHEN s < 20 THEN 'spm' ELSE 'psm' END AS form FROM u),
cut AS (SELECT *, substr(t, 1, lo) AS a, substr(t, lo + 1, hi - lo) AS b, substr(t, hi + 1) AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256, sha256(t) AS restored_sha256 FROM cut
"""

#: The others are similarity searches, hashes of spans, archives, trees or token ids; their tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_collocations": COLLOCATIONS_SQL, "op12_fill_in_middle": FILL_SQL}
