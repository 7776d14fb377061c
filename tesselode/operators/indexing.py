"""Incremental indexing: a state of files, symbols and edges, and what a new walk over the files makes of it.

    files(path, sha256)     symbols(id, path, kind, name, line, calls)     edges(id, kind, from_id, to_id, source, confidence)

A walk is compared by path and hash of the content in one full outer join. Only added and changed files are read
by the extractor; symbols of the others are carried over. Edges with the resolver's source tag are
made equal to what it finds now, edges of other sources stay while both their ends do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselode.operators.resolve import resolve_calls
from tesselode.operators.store import joined
from tesselode.sources.tables import settle

#: Fixed limit: files a full walk visits; a longer walk is cut in order of paths, and then nothing counts as vanished.
MAX_FILES = 50_000
#: Added and changed files up to which their paths are broadcast.
PICKED = 100_000
FILES = "path string, sha256 string"
SYMBOLS = "id string, path string, kind string, name string, line int, calls array<string>"
EDGES = "id string, kind string, from_id string, to_id string, source string, confidence double"


@dataclass(frozen=True)
class State:
    files: DataFrame
    symbols: DataFrame
    edges: DataFrame

    @staticmethod
    def empty(spark: SparkSession) -> State:
        return State(*[spark.createDataFrame([], s) for s in (FILES, SYMBOLS, EDGES)])


@dataclass(frozen=True)
class Pass:
    """What one walk did: the new state, each file's and symbol's fate, edges that came and went, symbols that a change touches.

    The symbols' fates are worked out when they are first asked for; the next walk needs none of them.
    """

    state: State
    files: DataFrame
    fates: Callable[[], DataFrame]
    edges: DataFrame
    before: DataFrame
    truncated: bool

    @cached_property
    def symbols(self) -> DataFrame:
        return settle(self.fates())

    @cached_property
    def affected(self) -> DataFrame:
        return dependents(self.symbols.where("status <> 'same'").select("id"), self.before.unionByName(self.edges.where("status = 'new'").drop("status")))


def _contents(walk: DataFrame) -> DataFrame:
    content = F.coalesce("content", F.lit(""))
    return walk.where("path IS NOT NULL").select("path", content.alias("content"), F.sha2(content, 256).alias("sha256"))


def walked(walk: DataFrame, limit: int = MAX_FILES) -> tuple[DataFrame, bool, bool]:
    """(path, sha256), one row for each path; whether the walk was longer than the limit; whether a path came with several contents.

    Null paths are left out, null contents are empty; of several contents the one with the least hash counts. Contents themselves are not shuffled.
    """
    out = settle(_contents(walk).groupBy("path").agg(F.min("sha256").alias("sha256"), F.count("*").alias("n")))
    total, most = out.agg(F.count("*"), F.max("n")).first()
    out = out.drop("n")
    return (out, False, (most or 0) > 1) if total <= limit else (out.orderBy("path").limit(limit), True, (most or 0) > 1)


def compare(old: DataFrame, walk: DataFrame, scope: DataFrame | None = None, whole: bool = True) -> DataFrame:
    """(path, status, sha256) of files(path, sha256) and a walk: added, changed, same, vanished.

    With scope(path) only its paths are looked at: those that the walk lacks have vanished, other files are the same.
    If the walk is not whole, what it lacks is the same too.
    """
    was, now = old.select("path", F.col("sha256").alias("was")), walk.select("path", F.col("sha256").alias("now"))
    if scope is not None:
        listed = scope.select("path").distinct()
        now = now.join(listed, "path", "left_semi")
        was = was.join(listed.withColumn("listed", F.lit(True)), "path", "left")
    else:
        was = was.withColumn("listed", F.lit(True))
    both = was.join(now, "path", "full_outer")
    gone = F.when(F.col("listed") & F.lit(whole or scope is not None), "vanished").otherwise("same")
    status = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), gone).when(F.col("was") == F.col("now"), "same").otherwise("changed")
    return both.select("path", status.alias("status"), F.coalesce("now", "was").alias("sha256"))


def synced(old: DataFrame, wanted: DataFrame, symbols: DataFrame, source: str, kind: str) -> DataFrame:
    """Edges with `status`: kept, new or gone. wanted(from_id, to_id, confidence) are those that `source` shall have of `kind`.

    An edge of another source between the same ends stands for a wanted one, which is then not added, or gone if it
    was there. Of equal edges of the source the least id stays. Edges of whatever source go with an end.
    """
    ids = symbols.select("id")
    alive = old.join(ids.withColumnRenamed("id", "from_id").withColumn("a", F.lit(True)), "from_id", "left").join(ids.withColumnRenamed("id", "to_id").withColumn("b", F.lit(True)), "to_id", "left")
    alive = alive.withColumn("alive", F.coalesce(F.col("a") & F.col("b"), F.lit(False))).drop("a", "b")
    own = (F.col("source").eqNullSafe(F.lit(source))) & (F.col("kind") == kind)
    others = alive.where(~own)
    held = others.where((F.col("kind") == kind) & F.col("alive")).select("from_id", "to_id").distinct().withColumn("held", F.lit(True))
    asked = wanted.join(held, ["from_id", "to_id"], "left").where("held IS NULL").select("from_id", "to_id", F.col("confidence").alias("asked"))
    mine = alive.where(own).groupBy("from_id", "to_id").agg(F.min("id").alias("least"), F.collect_list(F.struct("id", "confidence", "alive")).alias("rows"))
    met = mine.join(asked, ["from_id", "to_id"], "full_outer")
    had = met.where("least IS NOT NULL").select("from_id", "to_id", "asked", "least", F.explode("rows").alias("x"))
    stays = (F.col("x.id") == F.col("least")) & F.col("asked").isNotNull() & F.col("x.alive")
    cols = lambda status: ["id", F.lit(kind).alias("kind"), "from_id", "to_id", F.lit(source).alias("source"), "confidence", status.alias("status")]
    before = had.select(F.col("x.id").alias("id"), "from_id", "to_id", F.col("x.confidence").alias("confidence"), F.when(stays, "kept").otherwise("gone").alias("s")).select(*cols(F.col("s")))
    told = F.sha2(joined(F.lit(kind), F.col("from_id"), F.col("to_id"), F.lit(source)), 256)
    new = met.where("least IS NULL").select(told.alias("id"), "from_id", "to_id", F.col("asked").alias("confidence")).select(*cols(F.lit("new")))
    rest = others.select("id", "kind", "from_id", "to_id", "source", "confidence", F.when(F.col("alive"), "kept").otherwise("gone").alias("status"))
    return rest.unionByName(before).unionByName(new)


def dependents(touched: DataFrame, edges: DataFrame) -> DataFrame:
    """(id) of touched(id) and of what points at them, one level up: what a resolver has to look at again."""
    up = edges.join(touched.withColumnRenamed("id", "to_id"), "to_id", "left_semi").select(F.col("from_id").alias("id"))
    return touched.select("id").unionByName(up).distinct()


def reindex(state: State, walk: DataFrame, extract: Callable[[DataFrame], DataFrame], scope: DataFrame | None = None, source: str = "resolver", limit: int = MAX_FILES) -> Pass:
    """A pass over walk(path, content). extract gives symbols(id, path, kind, name, line, calls) of files(path, content).

    The state is read, never written in place: a pass that is run again gives the same result.
    """
    new, truncated, repeated = walked(walk, limit)
    fate = settle(compare(state.files, new, scope, not truncated))
    read = fate.where("status IN ('added', 'changed')").select("path", "sha256")
    told, n = _contents(walk), read.count()
    # few files are picked before they are read; many only after it, as symbols are smaller than contents
    if n <= PICKED:
        told = told.join(F.broadcast(read), ["path", "sha256"], "left_semi")
    elif repeated:
        told = told.join(read, ["path", "sha256"], "left_semi")
    found = extract(told.select("path", "content")).select("id", "path", "kind", "name", "line", "calls")
    if n > PICKED and not repeated:
        found = found.join(read.select("path"), "path", "left_semi").select("id", "path", "kind", "name", "line", "calls")
    fresh = settle(found.dropDuplicates(["id"]))
    read = read.select("path")
    carried = state.symbols.join(fate.where("status = 'same'").select("path"), "path", "left_semi")
    symbols = settle(carried.select("id", "path", "kind", "name", "line", "calls").unionByName(fresh))
    was, now = state.symbols.select("id", F.col("path").alias("old_path")), symbols.select("id", F.col("path").alias("new_path"))
    told = was.join(now, "id", "full_outer").join(read.withColumnsRenamed({"path": "new_path"}).withColumn("read", F.lit(True)), "new_path", "left")
    status = F.when(F.col("new_path").isNull(), "gone").when(F.col("old_path").isNull(), "new").when(F.col("read"), "again").otherwise("same")
    told = told.select("id", F.coalesce("new_path", "old_path").alias("path"), status.alias("status"))
    wanted = resolve_calls(symbols.select("id", "name", F.lit("").alias("owner"), "path", "calls"))
    links = settle(synced(state.edges, wanted, symbols, source, "CALLS"))
    files = fate.where("status <> 'vanished'").select("path", "sha256")
    return Pass(State(files, symbols, links.where("status <> 'gone'").drop("status")), fate, lambda: told, links, state.edges, truncated)


def report(done: Pass) -> DataFrame:
    """One row: files_seen, files_changed, files_deleted, functions, symbols_removed, edges_added, edges_removed, truncated."""
    count = lambda what, *names: F.count(F.when(F.col("status").isin(*names), 1)).alias(what)
    files = done.files.agg(count("files_seen", "added", "changed", "same"), count("files_changed", "added", "changed"), count("files_deleted", "vanished"))
    symbols = done.symbols.agg(count("functions", "new", "again", "same"), count("symbols_removed", "gone"))
    edges = done.edges.agg(count("edges_added", "new"), count("edges_removed", "gone"))
    return files.crossJoin(symbols).crossJoin(edges).withColumn("truncated", F.lit(done.truncated))  # one row each


def definitions(files: DataFrame) -> DataFrame:
    """symbols of files(path, content) whose functions begin at lines `def name(`: a call is an indented line `name()` below one. An extractor in column functions."""
    parts = files.select("path", F.posexplode(F.split(F.concat(F.lit("\n"), F.coalesce("content", F.lit(""))), "\ndef ")).alias("i", "part"))
    own = parts.where("i > 0").withColumn("name", F.regexp_extract("part", r"^([A-Za-z_]\w*)\(", 1)).where("name <> ''")
    calls = F.regexp_extract_all("part", F.lit(r"\n +([A-Za-z_]\w*)\(\)"), 1)
    return own.select(joined(F.col("path"), F.col("name")).alias("id"), "path", F.lit("Function").alias("kind"), "name", F.col("i").alias("line"), calls.alias("calls"))
