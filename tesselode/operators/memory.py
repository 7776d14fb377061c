"""Memories of a project: stored under their title, linked to the code they mention, searched, and folded by what they mention without losing a line.

A summary is kept as rows, one for each memory it holds, in order of (created, id), so that no task holds more than one memory of a
summary however many an entity has. Of equal lines the first in that order stays: a minimum over (summary, line), not a walk.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselode.operators import search as S
from tesselode.sources.tables import settle

# Bytes of a name that is linked, links of a name, the kind of a summary, how its title starts and how much of an id it shows, what stands for a memory that adds nothing.
NAME_BYTES, LINKS, FOLDED, TITLE, SHOWN, COVERED = 4, 5, "compacted", "Compacted: ", 8, "(content already covered by earlier memories)"
# Weights of the fields in a search; kinds that are linked, in order.
WEIGHTS = {"title": 3.0, "content": 1.0}
KINDS = ["Function", "Class", "Struct"]
SALTS = 32


def stored(log: DataFrame, entities: DataFrame) -> DataFrame:
    """(id, project, title, content, kind, agent, created, archived, entity_ids, entities): the last version of each title in log.

    log(project, title, content, kind, agent, created, seq): equal seqs go by content. entities(project, id, kind, name) are linked where
    title or content holds their name as an identifier, at most LINKS of a name by kind and id, names in order of their first place.
    Null projects and titles go, null contents are empty, null kinds and agents are note and unknown.
    """
    last = log.where("project IS NOT NULL AND title IS NOT NULL").groupBy("project", "title").agg(F.max(F.struct("seq", "content", "kind", "agent", "created")).alias("m"))
    text = lambda c, x: F.coalesce(c, F.lit(x))
    rows = last.select(F.sha2(F.concat_ws(":", F.length("project").cast("string"), "project", "title"), 256).alias("id"), "project", "title", text(F.col("m.content"), "").alias("content"), text(F.col("m.kind"), "note").alias("kind"), text(F.col("m.agent"), "unknown").alias("agent"), F.col("m.created").cast("string").alias("created"), F.lit(False).alias("archived"))
    words = F.array_distinct(F.regexp_extract_all(F.concat("title", F.lit("\n"), "content"), F.lit("[A-Za-z_][A-Za-z0-9_]*"), F.lit(0)))
    at = rows.select("id", "project", F.posexplode(words).alias("place", "name"))
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    known = entities.where(F.col("kind").isin(KINDS) & (F.octet_length("name") >= NAME_BYTES)).select("project", "name", order.alias("o"), F.col("id").alias("entity")).distinct()
    known = known.withColumn("salt", F.pmod(F.xxhash64("entity"), F.lit(SALTS)))
    for own in (["project", "name", "salt"], ["project", "name"]):
        known = known.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy("o", "entity"))).where(F.col("nth") <= LINKS)
    links = at.join(known.select("project", "name", "nth", "entity"), ["project", "name"]).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("place", "nth", "entity", "name"))).alias("x"))
    none = F.array().cast("array<string>")
    return rows.join(links, "id", "left").withColumn("entity_ids", F.coalesce("x.entity", none)).withColumn("entities", F.coalesce("x.name", none)).drop("x")


def find(memories: DataFrame, text: str, k: int, include_archived: bool = False) -> DataFrame:
    """(id, score): the k best memories for the text, by title and content; archived ones are neither found nor counted unless asked for."""
    own = memories if include_archived else memories.where("NOT coalesce(archived, false)")
    terms = list(S.query_terms(memories.sparkSession, text))
    return S.top(S.bm25_of(S.measured(own.select("id", *WEIGHTS), WEIGHTS, terms), terms), k)


def normalized(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), "[\\t\\n\\x0B\\f\\r \\u0085\\u00A0]+", " "))


@dataclass(frozen=True)
class Folded:
    """parts(project, key, created, id, text), summaries(project, key, title, compacted_count, is_new), folded(id, project, key) and a report for each project."""

    parts: DataFrame
    summaries: DataFrame
    folded: DataFrame
    report: DataFrame


def compacted(memories: DataFrame, min_group: int = 2) -> Folded:
    """Folds the active memories of each entity into its summary; a memory goes by the least name, then id, that it mentions.

    memories(project, id, title, content, kind, agent, created, archived, entity_ids, entities, member_ids). A group of fewer than max(2, min_group)
    is folded only into a summary that is there. Parts are a summary's old text, under created and id null, then a part for each
    memory. Null titles, agents and texts are empty, null archived is false; a memory without entities stays. Of two summaries of one
    entity that with the greater id is taken up. Ids are expected once.
    """
    empty = lambda c: F.coalesce(c, F.lit(""))
    all_rows = memories.where("project IS NOT NULL AND id IS NOT NULL").select("project", "id", *[empty(c).alias(c) for c in ("title", "content", "agent")], empty(F.col("created").cast("string")).alias("created"), empty("kind").alias("kind"), F.coalesce("archived", F.lit(False)).alias("archived"), F.coalesce("entity_ids", F.array().cast("array<string>")).alias("entity_ids"), F.coalesce("entities", F.array().cast("array<string>")).alias("entities"), F.coalesce("member_ids", F.array().cast("array<string>")).alias("member_ids"))
    old = all_rows.where(F.col("kind") == FOLDED).select("project", F.explode(F.array_distinct("entity_ids")).alias("key"), "id", "title", "content", F.size("member_ids").alias("n_old"))
    old = old.groupBy("project", "key").agg(F.max(F.struct("id", "title", "content", "n_old")).alias("old"))
    names = F.transform("entity_ids", lambda x, i: F.struct(empty(F.try_element_at("entities", i + 1)).alias("name"), x.alias("key")))
    active = all_rows.where((F.col("kind") != FOLDED) & ~F.col("archived") & (F.size("entity_ids") > 0)).withColumn("least", F.array_min(names))
    members = active.select("project", F.col("least.key").alias("key"), F.col("least.name").alias("name"), "id", "created", "title", "agent", "content")
    groups = members.groupBy("project", "key").agg(F.count("*").alias("n"), F.min("name").alias("name"), F.sum(F.octet_length("title") + F.octet_length("content")).alias("before"))
    groups = settle(groups.join(old, ["project", "key"], "left").where((F.col("n") >= max(2, min_group)) | F.col("old").isNotNull()))
    members = settle(members.drop("name").join(groups.select("project", "key"), ["project", "key"], "left_semi"))
    held = groups.where("old IS NOT NULL").select("project", "key", F.col("old.content").alias("content"))
    # where a line first stands: the old text comes before all, as its struct has no created
    first = F.struct(F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("id"), F.col("i"), F.col("line"))
    lines = held.select("project", "key", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("project", "key", first.alias("at"))
    own = members.select("project", "key", "created", "id", F.posexplode(F.split("content", "\n")).alias("i", "line")).select("project", "key", F.struct("created", "id", "i", "line").alias("at"))
    kept = lines.unionByName(own).withColumn("norm", normalized(F.col("at.line"))).where("norm <> ''").groupBy("project", "key", "norm").agg(F.min("at").alias("at"))
    bodies = kept.where("at.id IS NOT NULL").groupBy("project", "key", F.col("at.id").alias("id")).agg(F.array_sort(F.collect_list(F.struct("at.i", "at.line"))).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.regexp_replace(x["line"], "[ \\t]+$", "")), "\n")
    header = F.concat(F.lit("## "), "title", F.lit(" ("), "agent", F.lit(", "), "created", F.lit(")\n"))
    told = members.join(bodies, ["project", "key", "id"], "left").select("project", "key", "created", "id", F.concat(header, F.coalesce(body, F.lit(COVERED))).alias("text"))
    parts = settle(held.select("project", "key", F.lit(None).cast("string").alias("created"), F.lit(None).cast("string").alias("id"), F.col("content").alias("text")).unionByName(told))
    tail = F.regexp_replace(F.col("old.title"), f"^{TITLE}", "")
    name = F.when(F.col("name") != "", F.col("name")).otherwise(F.coalesce(tail, F.lit("")))
    summaries = groups.select("project", "key", F.concat(F.lit(TITLE), name, F.lit(" ["), F.substring("key", 1, SHOWN), F.lit("]")).alias("title"), (F.coalesce("old.n_old", F.lit(0)) + F.col("n")).alias("compacted_count"), F.col("old").isNull().alias("is_new"))
    # parts are joined by two line ends
    after = parts.groupBy("project", "key").agg((F.sum(F.octet_length("text").cast("long") + 2) - 2).alias("after")).groupBy("project").agg(F.sum("after").alias("chars_after"))
    report = groups.groupBy("project").agg(F.count("*").alias("summaries_updated"), F.sum("n").alias("memories_archived"), F.sum("before").alias("chars_before"))
    return Folded(parts, summaries, members.select("id", "project", "key"), report.join(after, "project").withColumn("lossless", F.lit(True)))
