"""Resolvers of calls and inheritance over symbols, as joins by name."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselode.operators.store import joined
from tesselode.sources.tables import settle

#: Rows of a key's left side that meet its right side at once, and pairs that a task makes.
BLOCK, TASK_PAIRS, MOST_TASKS = 512, 4_000_000, 8192
# Confidence by how a target was found, and the most targets of an ambiguous name.
SAME_FILE, UNIQUE, AMBIGUOUS, MOST, OWNER_MISSED = 0.9, 0.8, 0.5, 3, 0.8
# Endings of one group; an ending that no group names is its own.
GROUPS = {"js": ["js", "jsx", "ts", "tsx", "mjs", "cjs"], "c": ["c", "h", "cc", "cpp", "hpp", "cxx", "hxx", "hh"], "asm": ["s", "asm"]}
# The groups whose functions assembly may call, and the other way round.
ASM_LINKABLE = ["c", "go", "rs"]


def language_group(path: Column) -> Column:
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    out = ending
    for name, endings in GROUPS.items():
        out = F.when(ending.isin(endings), F.lit(name)).otherwise(out)
    return out


def _reachable(grp: Column) -> Column:
    """The groups whose names a group may mean."""
    linked = F.array(*[F.lit(g) for g in ASM_LINKABLE])
    return F.when(grp == "asm", F.concat(F.array(grp), linked)).when(grp.isin(ASM_LINKABLE), F.array(grp, F.lit("asm"))).otherwise(F.array(grp))


def paired(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The inner join on keys, for keys that many rows of both sides hold: tasks follow the pairs that come out, not the bytes that go in.

    A key's left rows are dealt over blocks, and its right rows go to each of them. Other columns must have names of their own.
    """
    count = lambda df, name: df.groupBy(*keys).agg(F.count("*").alias(name))
    sizes = settle(count(left, "_l").join(count(right, "_r"), keys).withColumn("_blocks", F.ceil(F.col("_l") / BLOCK).cast("int")))
    pairs = sizes.agg(F.sum(F.col("_l").cast("double") * F.col("_r"))).first()[0] or 0  # one row
    tasks = int(min(max(pairs // TASK_PAIRS, 1), MOST_TASKS))
    blocks = sizes.select(*keys, "_blocks")
    others = [c for c in left.columns if c not in keys]
    a = left.join(blocks, keys).withColumn("_block", F.expr(f"cast(pmod(xxhash64({', '.join(others)}), _blocks) as int)")).drop("_blocks")
    b = right.join(blocks, keys).withColumn("_block", F.explode(F.expr("sequence(0, _blocks - 1)"))).drop("_blocks")
    if tasks > 1:
        a, b = a.repartition(tasks, *keys, "_block"), b.repartition(tasks, *keys, "_block")
    return a.hint("merge").join(b, [*keys, "_block"]).drop("_block")


def _sorted_out(wanted: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """wanted(caller, call, path, grp, name) that targets(name, target, t_path, t_grp) of the same file settle, as they are, and (caller, call, target, confidence) of the others: one alone, else up to MOST.

    Names meet by name and file first. Where that finds nothing, they meet a summary of one row for each name and
    group, with its count and its first MOST + 1 holders: a name that thousands hold is one row.
    """
    near = wanted.join(targets.select("name", F.col("t_path").alias("path")).distinct(), ["name", "path"], "left_semi").select(*wanted.columns)
    first = F.row_number().over(Window.partitionBy("name", "t_grp").orderBy("target"))
    few = targets.withColumn("r", first).where(F.col("r") <= MOST + 1).groupBy("name", F.col("t_grp").alias("reach")).agg(F.count("*").alias("n"), F.collect_list("target").alias("targets"))
    rest = wanted.join(near.select("caller", "call").distinct(), ["caller", "call"], "left_anti").withColumn("reach", F.explode(_reachable(F.col("grp"))))
    met = rest.join(few, ["name", "reach"]).groupBy("caller", "call").agg(F.sum("n").alias("n"), F.flatten(F.collect_list("targets")).alias("targets")).where(F.col("n") <= MOST)
    return near, met.select("caller", "call", F.explode("targets").alias("target"), F.when(F.col("n") == 1, UNIQUE).otherwise(AMBIGUOUS).alias("confidence"))


def _repeated(rows: DataFrame, key: str) -> bool:
    """Whether a key stands in more than one of the rows."""
    return not rows.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def resolve_calls(symbols: DataFrame) -> DataFrame:
    """(from_id, to_id, confidence) of symbols(id, name, owner, path, calls): the best of each pair, without calls to oneself.

    A call 'Owner.m' goes to methods of that owner; if the owner's method is known but cannot be reached, or is not
    known, the bare name is tried, in the first case at OWNER_MISSED of the confidence. Names without a reachable
    target, or with more than MOST of equal rank, give nothing. Null or empty names and calls give nothing.

    Pairs of one file, which grow with the square of a name's holders, are not shuffled unless ids repeat.
    """
    own = symbols.where("name IS NOT NULL AND name <> ''").select("id", "name", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("path", F.lit("")).alias("path"))
    own = own.withColumn("grp", language_group(F.col("path")))
    repeated = _repeated(symbols, "id")
    once = lambda df: df.distinct() if repeated else df
    own = once(own)
    target = lambda df, name, *more: df.select(name.alias("name"), F.col("id").alias("target"), F.col("path").alias("t_path"), F.col("grp").alias("t_grp"), *more)
    bare = target(own, F.col("name"), "owner")
    full = target(own.where("owner <> ''"), F.concat_ws(".", "owner", "name"))
    calls = symbols.select(F.col("id").alias("caller"), F.coalesce("path", F.lit("")).alias("path"), F.explode(F.array_distinct("calls")).alias("call")).where("call IS NOT NULL AND call <> ''")
    calls = once(calls).withColumn("grp", language_group(F.col("path")))
    dotted = calls.where(F.col("call").contains("."))
    near_full, by_owner = _sorted_out(dotted.withColumn("name", F.col("call")), full)
    near_full, by_owner = settle(near_full), settle(by_owner)
    known = full.select(F.col("name").alias("call"), F.lit(True).alias("known")).distinct()
    done = near_full.select("caller", "call").unionByName(by_owner.select("caller", "call")).distinct()
    missed = dotted.join(done, ["caller", "call"], "left_anti").join(known, "call", "left")
    short = missed.withColumn("name", F.element_at(F.split("call", r"\."), -1)).withColumn("part", F.when(F.col("known"), OWNER_MISSED).otherwise(1.0)).drop("known")
    plain = calls.where(~F.col("call").contains(".")).withColumn("name", F.col("call")).withColumn("part", F.lit(1.0))
    asked = settle(short.unionByName(plain))
    near_bare, far = _sorted_out(asked, bare)
    far = far.join(asked.select("caller", "call", "part").distinct(), ["caller", "call"]).withColumn("confidence", F.col("confidence") * F.col("part")).drop("part")
    # pairs of one file come last and are told as they meet: a caller asks once for a bare name, and leaves out those owners that it asks for by name
    last = F.element_at(F.split("call", r"\."), -1)
    owners = F.expr("left(call, length(call) - length(name) - 1)")
    told = near_full.select("caller", "path", last.alias("name"), "call").withColumn("owner", owners)
    both = near_bare.select("caller", "path", "name", "part", F.lit(None).cast("string").alias("owner")).unionByName(told.select("caller", "path", "name", F.lit(None).cast("double").alias("part"), "owner"))
    both = both.groupBy("caller", "path", "name").agg(F.max("part").alias("part"), F.collect_set("owner").alias("owners")).where("part IS NOT NULL")
    both = settle(both)
    here = lambda df, *more: df.select("name", "target", F.col("t_path").alias("path"), *more)
    wide = paired(both, here(bare, "owner"), ["name", "path"]).where("caller <> target AND NOT array_contains(owners, owner)")
    narrow = paired(near_full.select("caller", "path", "name").distinct(), here(full), ["name", "path"]).where("caller <> target")
    near = wide.select("caller", "target", (F.col("part") * SAME_FILE).alias("confidence")).unionByName(narrow.select("caller", "target", F.lit(SAME_FILE).alias("confidence")))
    best = lambda df: df.groupBy("caller", "target").agg(F.max("confidence").alias("confidence"))
    far = by_owner.unionByName(far).where("caller <> target").select("caller", "target", "confidence")
    # a pair of one file is never one of two files, and each of them meets once unless ids repeat
    found = best(near.unionByName(far)) if repeated else near.unionByName(best(far))
    return found.select(F.col("caller").alias("from_id"), F.col("target").alias("to_id"), F.round("confidence", 4).alias("confidence"))


def resolve_inheritance(types: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, from_id, to_id, confidence) of relations(path, sub, rel, super) over types(id, name, path): rel extends or implements.

    Each end is picked by name, as calls are; an edge has the lesser confidence of its ends, the best of each pair.
    Pairs of one file, which grow with the square of a name's holders, are not shuffled unless ids repeat.
    """
    own = types.where("name IS NOT NULL AND name <> ''").select("name", F.col("id").alias("target"), F.coalesce("path", F.lit("")).alias("t_path"))
    own = own.withColumn("t_grp", language_group(F.col("t_path")))
    told = relations.where("sub <> '' AND super <> '' AND lower(rel) IN ('extends', 'implements')").select(F.coalesce("path", F.lit("")).alias("path"), "sub", F.upper("rel").alias("kind"), "super").distinct()
    told = settle(told.withColumn("grp", language_group(F.col("path"))).withColumn("caller", joined(*[F.col(c) for c in ("path", "sub", "kind", "super")])))
    repeated = _repeated(types, "id")
    own = own.distinct() if repeated else own
    near, far = {}, {}
    for c in ("sub", "super"):
        near[c], far[c] = (settle(x) for x in _sorted_out(told.select("caller", "path", "grp", F.col(c).alias("call"), F.col(c).alias("name")), own))
    here = lambda end: own.select(F.col("target").alias(end), "name", F.col("t_path").alias("path"))
    # both ends in the relation's file: such a pair is told by one relation and comes last, as it meets
    inner = told.join(near["sub"].select("caller"), "caller", "left_semi").join(near["super"].select("caller"), "caller", "left_semi")
    left = paired(inner.select("kind", "path", F.col("sub").alias("name"), "super"), here("from_id"), ["name", "path"])
    left = settle(left.select("kind", "path", F.col("super").alias("name"), "from_id"))
    whole = paired(left, here("to_id"), ["name", "path"]).where("from_id <> to_id").select("kind", "from_id", "to_id", F.lit(SAME_FILE).alias("confidence"))
    # an end or both elsewhere, where an end has up to MOST targets; what a relation of one file tells is told already
    rest = told.select("caller", "kind", "path", "sub", "super").join(inner.select("caller"), "caller", "left_anti")
    for c, t in (("sub", "from_id"), ("super", "to_id")):
        found = near[c].select("caller", "name", "path").join(rest.select("caller"), "caller", "left_semi")
        found = paired(found, here(t), ["name", "path"]).select("caller", F.col(t), F.lit(SAME_FILE).alias(f"c_{t}"))
        rest = rest.join(found.unionByName(far[c].select("caller", F.col("target").alias(t), F.col("confidence").alias(f"c_{t}"))), "caller")
    rest = settle(rest.where("from_id <> to_id").groupBy("kind", "from_id", "to_id", "sub", "super").agg(F.max(F.least("c_from_id", "c_to_id")).alias("confidence")))
    if repeated:
        return whole.unionByName(rest.select(*whole.columns)).groupBy("kind", "from_id", "to_id").agg(F.max("confidence").alias("confidence"))
    path = lambda t: own.select(F.col("target").alias(t), F.col("t_path").alias(f"{t}_path"))
    same = rest.join(path("from_id"), "from_id").join(path("to_id"), "to_id").where("from_id_path = to_id_path").withColumnRenamed("from_id_path", "path")
    same = same.join(inner.select("kind", "path", "sub", "super"), ["kind", "path", "sub", "super"], "left_semi").select("kind", "from_id", "to_id")
    return whole.unionByName(rest.join(same, ["kind", "from_id", "to_id"], "left_anti").select(*whole.columns))
