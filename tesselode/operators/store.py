"""The property graph as append-only tables, and what reads and rewrites them.

A node log has a row for each write: (seq, kind, id, props). The state of a node is the merge of its writes, the latest
value of each property by seq; nothing is updated in place, so a rerun gives the same state. Edges are
(id, kind, from_id, to_id, props); equal ones by kind, ends and properties are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PROPS = "map<string,string>"


def entries(props: Column) -> Column:
    """Properties as key and value pairs in order of keys, to compare or group by; null ones are empty."""
    return F.coalesce(F.array_sort(F.map_entries(props)), F.expr("cast(array() as array<struct<key:string,value:string>>)"))


def joined(*parts: Column) -> Column:
    """Texts as one, each behind its length, so that different ones never look alike; a missing text counts as empty."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.concat(*[x for t in texts for x in (F.length(t).cast("string"), F.lit(":"), t)])


def props_text(props: Column) -> Column:
    """Properties as 'key=value' in order of keys, joined by ';'."""
    pairs = F.array_sort(F.map_entries(props))
    return F.array_join(F.transform(pairs, lambda e: F.concat_ws("=", e["key"], e["value"])), ";")


def merged(log: DataFrame) -> DataFrame:
    """(kind, id, props) of a node log: of each property the value of the largest seq, ties to the largest value; null values never count.

    A node is one row however often it was written; the shuffle carries one partial maximum for each node and property.
    """
    cell = log.select("kind", "id", "seq", F.explode_outer("props").alias("key", "value"))
    latest = cell.groupBy("kind", "id", "key").agg(F.max(F.when(F.col("value").isNotNull(), F.struct("seq", "value"))).alias("x"))
    pairs = F.collect_list(F.when(F.col("key").isNotNull() & F.col("x").isNotNull(), F.struct("key", F.col("x.value").alias("value"))))
    return latest.groupBy("kind", "id").agg(F.map_from_entries(F.array_sort(pairs)).alias("props"))


def linked(edges: DataFrame) -> DataFrame:
    """Each edge once by kind, ends and properties; the least id stays."""
    best = edges.withColumn("same", entries(F.col("props"))).groupBy("kind", "from_id", "to_id", "same").agg(F.min("id").alias("id"), F.first("props", True).alias("props"))
    return best.select("id", "kind", "from_id", "to_id", "props")


def without_nodes(nodes: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """nodes and edges without ids(id) and every edge that touches one."""
    gone = ids.select(F.col("id").alias("gone")).distinct()
    left = edges.join(gone, F.col("from_id") == F.col("gone"), "left_anti").join(gone, F.col("to_id") == F.col("gone"), "left_anti")
    return nodes.join(gone, F.col("id") == F.col("gone"), "left_anti"), left


def without_edges(edges: DataFrame, ids: DataFrame) -> DataFrame:
    return edges.join(ids.select(F.col("id").alias("gone")).distinct(), F.col("id") == F.col("gone"), "left_anti")


def find_nodes(nodes: DataFrame, kind: str | None = None, filters: dict[str, str | None] | None = None) -> DataFrame:
    """Nodes of a kind whose properties equal all filters (null: the property is missing), in order of ids."""
    out = nodes if kind is None else nodes.where(F.col("kind") == kind)
    for key, value in (filters or {}).items():
        out = out.where(F.col("props")[key].eqNullSafe(F.lit(value)))
    return out.orderBy("id")


def listed(nodes: DataFrame, kind: str, columns: list[str]) -> DataFrame:
    """(id, columns..) of the nodes of a kind, a property each; null where a node lacks it."""
    return nodes.where(F.col("kind") == kind).select("id", *[F.col("props")[c].alias(c) for c in columns])


def present(nodes: DataFrame) -> DataFrame:
    """(id, row): a node as one flat map of id, kind and properties; a property of that name overrides."""
    own = F.create_map(F.lit("id"), F.col("id"), F.lit("kind"), F.col("kind"))
    return nodes.select("id", F.map_from_entries(F.map_entries(F.map_filter(own, lambda k, _: ~F.coalesce(F.map_contains_key("props", k), F.lit(False))))).alias("own"), "props").select("id", F.map_concat("own", F.coalesce("props", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("row"))


def find(nodes: DataFrame, kinds: list[str], text: str, limit: int = 20) -> DataFrame:
    """nodes(id, kind, name, qualified_name) by name: those that have exactly this name or qualified name if there are any, else all that hold the text, whatever the case.

    In order of kinds as listed, then of name and id. Null names hold nothing.
    """
    name, qualified = (F.coalesce(F.col(c), F.lit("")) for c in ("name", "qualified_name"))
    low = text.lower()
    own = nodes.where(F.col("kind").isin(kinds)).where(F.lower(name).contains(low) | F.lower(qualified).contains(low))
    own = own.withColumn("exact", (name == text) | (qualified == text))
    any_exact = own.agg(F.coalesce(F.max("exact"), F.lit(False)).alias("any_exact"))  # one row
    rank = F.array_position(F.array(*[F.lit(k) for k in kinds]), F.col("kind"))
    out = own.crossJoin(F.broadcast(any_exact)).where(F.col("exact") | ~F.col("any_exact"))
    return out.orderBy(rank, "name", "id").limit(limit).select(*nodes.columns)


def named(nodes: DataFrame, text: str) -> DataFrame:
    """The nodes(id, name, qualified_name, ..) that a name means: for a text with a dot those of that qualified name, else those of that name, else those of that name whatever the case, else the first by name and id that holds the text.

    All holders are told but in the last step.
    """
    name, qualified, low = F.coalesce("name", F.lit("")), F.coalesce("qualified_name", F.lit("")), text.lower()
    dotted = F.lit("." in text) & (qualified == text)
    step = F.when(dotted, 0).when((name == text) | (qualified == text), 1).when(F.lower(name) == low, 2).when(F.lower(name).contains(low) | F.lower(qualified).contains(low), 3)
    held = nodes.withColumn("step", step)
    least = held.agg(F.min("step")).first()[0]  # one row
    out = held.where(F.col("step") == F.lit(least)).drop("step")
    return out.orderBy("name", "id").limit(1) if least == 3 else out
