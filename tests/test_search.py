"""Terms, ranks and rules against plain values."""

import pytest
from pyspark.sql import functions as F

from tesselode.functions import text_rules as R
from tesselode.operators import search as S


def terms(spark, text):
    return spark.range(1).select(S.tokens(F.lit(text)).alias("t")).first()["t"]


@pytest.mark.parametrize(
    "text, want",
    [
        ("ParsePacket parse_headers HTTPServer tracks", "parsepacket parse packet parse header httpserver http server track"),
        ("utf8Decoder x2y", "utf8decoder utf 8 decoder x2y x 2 y"),
        ("queries boxes glasses class as ABC aB", "query box glasse class as abc ab a b"),
        ("ABCd ÉtatMajor naïve", "abcd ab cd étatmajor état major naïve"),
        ("", ""),
        (" - _ ", ""),
    ],
)
def test_tokens(spark, text, want):
    assert terms(spark, text) == want.split()


def ranked_docs(spark):
    rows = [("a", "parse packet", "other things"), ("b", "nothing here", "a parse of one packet"), ("c", "neither", "at all"), ("d", "stuffed", "parse " * 40)]
    return spark.createDataFrame(rows, "id string, title string, body string")


def test_bm25_order_and_edges(spark):
    docs = ranked_docs(spark)
    words = list(S.query_terms(spark, "parse packet"))
    figures = S.measured(docs, {"title": 3.0, "body": 1.0}, words)
    got = [r["id"] for r in S.top(S.bm25_of(figures, words), 10).collect()]
    assert got[0] == "a" and set(got) == {"a", "b", "d"}
    assert S.bm25_of(S.measured(docs, {"title": 3.0}, []), []).count() == 0
    assert S.bm25_of(S.measured(docs.where("false"), {"title": 3.0}, words), words).count() == 0
    nulls = spark.createDataFrame([("x", None, None), ("y", "parse", None)], docs.schema)
    assert [r["id"] for r in S.bm25_of(S.measured(nulls, {"title": 1.0, "body": 1.0}, words), words).collect()] == ["y"]


def test_cosine_equals_a_plain_one(spark):
    docs = ranked_docs(spark)
    asked = S.query_terms(spark, "parse packet parse")
    got = {r["id"]: r["score"] for r in S.cosine_of(S.measured(docs, {"title": 1.0, "body": 1.0}, list(asked)), asked).collect()}
    bags = {r["id"]: terms(spark, r["title"] + " " + r["body"]) for r in docs.collect()}
    for i, bag in bags.items():
        dot = sum(c * bag.count(t) for t, c in asked.items())
        norm = sum(bag.count(t) ** 2 for t in set(bag)) ** 0.5 * sum(c * c for c in asked.values()) ** 0.5
        assert (i in got) == (dot > 0) and (not dot or abs(got[i] - dot / norm) < 1e-9)


def test_fusion_and_ranks(spark):
    one = spark.createDataFrame([("a", 3.0), ("b", 2.0), ("c", 1.0)], "id string, score double")
    two = spark.createDataFrame([("c", 3.0), ("b", 2.0), ("d", 1.0)], "id string, score double")
    got = [r["id"] for r in S.top(S.fuse(one, two), 2).collect()]
    assert set(got) == {"b", "c"}
    many = spark.range(1000).select(F.col("id"), (F.col("id") % 17).cast("double").alias("score")).repartition(7)
    want = sorted(((-(i % 17), i) for i in range(1000)))
    assert {r["id"]: r["rank"] for r in S.ranked(many).collect()} == {i: k + 1 for k, (_, i) in enumerate(want)}


def test_complexity_and_risk(spark):
    rows = [("if (a && b) { for x; while y } elif iffy", 5), ("switch { case 1: case 2: } catch || _if", 5), ("", 1), (None, None)]
    got = spark.createDataFrame(rows, "t string, want int").select(R.complexity(F.col("t")).alias("c"), "want").collect()
    assert all(r["c"] == r["want"] for r in got)
    risk = lambda *x: spark.range(1).select(R.risk_level(*[F.lit(v) for v in x]).alias("r")).first()["r"]
    assert [risk(0, 0, 0, 0, 0), risk(1, 0, 0, 0, 1), risk(26, 1, 0, 0, 0), risk(1, 1, 2, 0, 0), risk(1, 9, 0, 1, 0)] == ["low", "medium", "medium", "high", "high"]
