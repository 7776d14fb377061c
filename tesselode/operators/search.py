"""Ranked retrieval: tokens, BM25F, term-frequency cosine, reciprocal rank fusion, substring fallback."""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesselode.sources.tables import settle

#: Fixed values of the ranking.
K1, B, RRF_K = 1.2, 0.75, 60


def tokens(text: Column) -> Column:
    """Terms of a text: words of letters and digits, and their parts at camel and digit boundaries.

    A word of several parts is a term itself, before its parts. Terms are in lower case with plural endings cut:
    ies to y, es and s off where a stem is left. Lengths are in bytes. Null: null.
    """
    mark = "\u0001"
    # boundaries: lower before upper, the last of several uppers before a lower, letter before digit and the other way round
    cut = F.regexp_replace(text, r"[^\p{L}\p{Nd}]+", " ")
    for pattern in (r"(\p{Lu})(\p{Lu}\p{Ll})", r"(\p{Ll})(\p{Lu})", r"(\p{L})(\p{Nd})", r"(\p{Nd})(\p{L})"):
        cut = F.regexp_replace(cut, pattern, f"$1{mark}$2")
    words = F.filter(F.split(cut, " "), lambda w: w != "")
    parts = lambda w: F.split(w, mark)
    terms = F.flatten(F.transform(words, lambda w: F.when(w.contains(mark), F.concat(F.array(F.replace(w, F.lit(mark), F.lit(""))), parts(w))).otherwise(F.array(w))))
    n = F.octet_length

    def stem(w: Column) -> Column:
        head = lambda k: F.substring(w, F.lit(1), F.length(w) - k)
        return (
            F.when((n(w) > 4) & w.endswith("ies"), F.concat(head(3), F.lit("y")))
            .when((n(w) > 4) & w.endswith("es") & ~w.endswith("ses"), head(2))
            .when((n(w) > 3) & w.endswith("s") & ~w.endswith("ss"), head(1))
            .otherwise(w)
        )

    return F.transform(F.transform(terms, F.lower), stem)


def query_terms(spark: SparkSession, text: str) -> dict[str, int]:
    """The terms of a query and how often each occurs."""
    row = spark.range(1).select(tokens(F.lit(text)).alias("t")).first()
    return dict(Counter(row["t"] or []))


def measured(docs: DataFrame, fields: dict[str, float], terms: list[str]) -> DataFrame:
    """(id, len, norm, tf, n) of each document in one narrow pass: weighted length, norm of its plain counts, and weighted and plain counts of the terms.

    Texts are read once and nothing but these figures is kept, in a written table; no posting is shuffled.
    """
    own = docs.select("id", *[tokens(F.coalesce(F.col(f), F.lit(""))).alias(f"_t{i}") for i, f in enumerate(fields)])
    weights = list(fields.values())
    cols = [F.col(f"_t{i}") for i in range(len(weights))]
    total = sum((F.size(c) * F.lit(float(w)) for c, w in zip(cols, weights, strict=True)), F.lit(0.0))
    counts = lambda t: [F.size(F.filter(c, lambda x: x == F.lit(t))) for c in cols]
    tf = F.array(*[sum((c * F.lit(float(w)) for c, w in zip(counts(t), weights, strict=True)), F.lit(0.0)) for t in terms]) if terms else F.array().cast("array<double>")
    n = F.array(*[sum(counts(t), F.lit(0)) for t in terms]) if terms else F.array().cast("array<int>")
    # sum of squared counts: 2 * place in the run of equal terms - 1 adds up to the square
    start = F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("squares"))

    def step(acc: Column, x: Column) -> Column:
        run = F.when(acc["term"] == x, acc["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(x.alias("term"), run.alias("run"), (acc["squares"] + 2 * run - 1).alias("squares"))

    squares = F.aggregate(F.array_sort(F.flatten(F.array(*cols))), start, step, lambda acc: acc["squares"])
    return settle(own.select("id", total.alias("len"), F.sqrt(squares).alias("norm"), tf.alias("tf"), n.alias("n")))


def bm25_of(figures: DataFrame, terms: list[str]) -> DataFrame:
    """(id, score) of measured documents with a positive score; every document counts for N and the mean length."""
    df = [F.sum((F.col("n")[i] > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))]
    row = figures.agg(F.count("*").alias("n_docs"), F.sum("len").alias("total"), *df).first()  # one row of figures
    if not terms or not row["n_docs"] or not row["total"]:
        return figures.select("id", F.lit(0.0).alias("score")).where("false")
    norm = lambda i: F.col("tf")[i] + K1 * (1 - B + B * F.col("len") / (row["total"] / row["n_docs"]))
    idf = [math.log(1 + (row["n_docs"] - (row[f"df{i}"] or 0) + 0.5) / ((row[f"df{i}"] or 0) + 0.5)) for i in range(len(terms))]
    score = sum((F.lit(idf[i]) * F.col("tf")[i] * (K1 + 1) / norm(i) for i in range(len(terms))), F.lit(0.0))
    return figures.select("id", score.alias("score")).where("score > 0")


def cosine_of(figures: DataFrame, terms: dict[str, int]) -> DataFrame:
    """(id, score): cosine of plain term counts of measured documents, where above 0."""
    own = math.sqrt(sum(c * c for c in terms.values())) or 1.0
    dot = sum((F.col("n")[i] * c for i, c in enumerate(terms.values())), F.lit(0))
    return figures.where(dot > 0).select("id", (dot / (F.col("norm") * own)).alias("score"))


def ranked(ranking: DataFrame) -> DataFrame:
    """(id, rank) by score, to nine digits, then id, without one task for all: ranges are sorted each for itself, and begin after those above."""
    rows = ranking.select("id", F.round("score", 9).alias("score")).repartitionByRange(F.desc("score"), "id").sortWithinPartitions(F.desc("score"), "id")
    # the low 33 bits of this id count the rows of a partition
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    rows = settle(rows.select("id", F.spark_partition_id().alias("part"), place.alias("place")))
    sizes = rows.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    return rows.join(F.broadcast(starts), "part").select("id", (F.col("start") + F.col("place") + 1).alias("rank"))


def fuse(*rankings: DataFrame) -> DataFrame:
    """Reciprocal rank fusion of (id, score) rankings: the sum of 1 / (60 + rank)."""
    parts = [ranked(r).select("id", (1 / (RRF_K + F.col("rank"))).alias("part")) for r in rankings]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("score"))


def top(ranking: DataFrame, k: int) -> DataFrame:
    return ranking.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def with_fallback(ranking: DataFrame, docs: DataFrame, field: str, text: str, k: int) -> DataFrame:
    """The ranking, or if it is empty documents that hold the text, at score 0."""
    plain = docs.where(F.lower(field).contains(text.lower())).select("id", F.lit(0.0).alias("score"))
    empty = ranking.agg((F.count("*") == 0).alias("none"))
    return top(ranking.unionByName(plain.crossJoin(F.broadcast(empty)).where("none").select("id", "score")), k)  # by one row
