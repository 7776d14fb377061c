import random
import zlib
from collections import Counter, defaultdict

from tesselode.llm.kd_shards import kd_shards

SCHEMA = "doc_id long, text string, shard string"


def check(rows, got, slack):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in rows)
    assert Counter((g["doc_id"], g["size"], g["text_crc32"]) for g in got) == want
    slots, size, homes = defaultdict(list), Counter(), defaultdict(set)
    for g in got:
        assert g["law"] == "bytes" and g["grown_shard"] is None and 0 <= g["shard"] < 16
        slots[g["shard"]].append(g["slot"])
        size[g["shard"]] += g["size"]
        homes[(g["text_crc32"], g["size"])].add(g["shard"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(h) == 1 for h in homes.values())
    if slack is not None:
        mean = sum(size.values()) / 16
        assert max(abs(size[s] - mean) for s in range(16)) <= slack * mean, size


def test_documents(spark, sf):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").selectExpr("doc_id", "text", "lang as shard")
    check([tuple(r) for r in docs.collect()], kd_shards(docs).collect(), 0.5)


def test_even_sizes_are_near_equal(spark):
    r = random.Random(2)
    rows = [(i, "".join(r.choice("abcdef ") for _ in range(r.choice([20, 20, 20, 50, 300]))), "x") for i in range(4000)]
    check(rows, kd_shards(spark.createDataFrame(rows, SCHEMA)).collect(), 0.05)


def test_hot_groups_nulls_repeats_and_empty(spark):
    rows = [(i, "copy of one text" if i % 3 else "t%d" % i, None) for i in range(300)] + [(7, None, None), (8, "", "x"), (None, "z", "x"), (9, "same", "x"), (9, "same", "x")]
    check(rows, kd_shards(spark.createDataFrame(rows, SCHEMA)).collect(), None)
    assert kd_shards(spark.createDataFrame([], SCHEMA)).count() == 0
    one = [(i, "all alike", "x") for i in range(50)]
    check(one, kd_shards(spark.createDataFrame(one, SCHEMA)).collect(), None)
