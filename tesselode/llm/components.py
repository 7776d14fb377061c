"""Connected components by alternating large and small stars, all in joins and aggregates.

Each round links every node to the least of its neighbourhood; the edge list stays no longer
than the links. A node with very many links is met by partial aggregation, and its least neighbour
is broadcast to its links; nothing gathers a component in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import attach, materialise

#: Rounds after which the loop gives up; it needs about log2 of the longest path.
MAX_ROUNDS = 60


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) with u > v; the star of each node around the least of its neighbourhood. Large stars repeat no more rows than edges has."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n")))
        out = attach(both, least, ["u"], "n")
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u > v")
    least = materialise(edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")))
    out = attach(edges, least, ["u"], "n")
    return out.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u > v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether distinct edges(u, v) with u > v are stars: each u has one v, and no v is a u."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("below")))
    ends = ends.groupBy("node").agg(F.sum("below").alias("n"), F.min("below").alias("least"))
    return ends.where("n > 1 or (n = 1 and least = 0)").count() == 0


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of links(a, b) but the least of each component."""
    edges = materialise(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    for _ in range(MAX_ROUNDS):
        if _settled(edges):
            return edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
        edges = materialise(_stars(materialise(_stars(edges, True)), False))
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
