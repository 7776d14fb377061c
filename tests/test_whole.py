"""Queries that once took a part of a table, against plain versions over all of it."""

import sys
from collections import defaultdict
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
import __spark_entry__  # noqa: E402, F401
from tesselode.plans.catalog import QUERIES  # noqa: E402


def rows(spark, sf, name):
    return {tuple(r) for r in QUERIES[name](spark, sf).collect()}


def test_hunk_overlap_over_all_orders(spark, sf):
    every = rows(spark, sf, "hunk_overlap")
    assert {r[0] % 10 for r in every} == set(range(10))
    lines = defaultdict(list)
    for r in spark.read.parquet(f"{sf}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_quantity").collect():
        lines[r[0]].append((r[1], r[2]))
    want = {(o, i, j) for o, x in lines.items() for i, p in x for j, q in x if i < j and p <= q + 5 and q <= p + 5}
    assert {r[:3] for r in every} == want


def test_signature_classes_hold_all_pairs(spark, sf):
    members = rows(spark, sf, "signature_similar")
    parts = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", "p_brand", "p_size").collect()
    of = {r[0]: (r[1], r[2]) for r in parts}
    assert len(members) == len(parts)
    for i, c, n in members:
        alike = [j for j, x in of.items() if x == of[i]]
        assert c == min(alike) and n == len(alike) - 1


def test_mentions_of_all_items(spark, sf):
    every = rows(spark, sf, "mentions_link")
    assert max(r[1] for r in every) >= 10
    by = defaultdict(set)
    for doc, item, word in every:
        by[item, word].add(doc)
    assert max(map(len, by.values())) == 5
