"""K-d tree partitioning into shards of near-equal bytes, in DataFrame functions only.

A node splits at the weighted median of its widest dimension (range over the whole table's
range). The median comes from histograms of every node of a level at once: each pass sums the
weights of BINS equal bins and narrows to the bin where half the weight falls, until the value
is exact; equal values are then split by a hash of the text in the same way. The driver sees
BINS sums for each node, never rows. Dimensions come from the text alone, so equal texts take
the same way down the tree and stay together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import materialise

BINS = 512
#: A split may miss the middle by this part of its node's weight.
TOLERANCE = 0.0005
#: Sub-ranges of a shard within which slots are numbered side by side.
LANES = 256
_TOP = 2**63 - 1


def _table(spark: SparkSession, rows: Sequence[tuple], columns: str) -> DataFrame:
    """A few rows, one for each node of a level, as an inline table to broadcast."""
    text = ", ".join("(" + ", ".join("cast(null as long)" if x is None else f"cast('{x}' as long)" for x in r) + ")" for r in rows)
    return F.broadcast(spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})"))


def _at(dims: Sequence[str], k: Column) -> Column:
    return F.element_at(F.array(*[F.col(d) for d in dims]), (k + 1).cast("int"))


def _descend(rows: DataFrame, level: list[tuple[int, int, int, int]], dims: Sequence[str], tie: str) -> DataFrame:
    """rows with node, one level further down; level: (node, dimension, value, tie value)."""
    x = rows.join(_table(rows.sparkSession, level, "node, k, cut, cut_tie"), "node")
    v = _at(dims, F.col("k"))
    left = (v < F.col("cut")) | ((v == F.col("cut")) & (F.col(tie) <= F.col("cut_tie")))
    return x.withColumn("node", F.col("node") * 2 + F.when(left, 0).otherwise(1)).drop("k", "cut", "cut_tie")


def _cuts(units: DataFrame, picked: dict[int, int], dims: Sequence[str], tie: str, weight: str) -> dict[int, tuple[int, int]]:
    """(value, tie value) of the weighted median of each node's picked dimension."""
    spark = units.sparkSession
    tagged = units.join(_table(spark, list(picked.items()), "node, k"), "node").withColumn("v", _at(dims, F.col("k")))
    state, cuts = {}, {}
    for r in tagged.groupBy("node").agg(F.min("v"), F.max("v"), F.sum(weight)).collect():
        state[r[0]] = {"fixed": None, "lo": r[1], "hi": r[2], "below": 0, "total": r[3]}
    while len(cuts) < len(state):
        now = {i: s for i, s in state.items() if i not in cuts}
        rows = tagged.join(_table(spark, [(i, s["fixed"], s["lo"], s["hi"]) for i, s in now.items()], "node, fixed, lo, hi"), "node")
        rows = rows.withColumn("x", F.when(F.col("fixed").isNull(), F.col("v")).otherwise(F.col(tie)))
        rows = rows.where("(fixed is null or v = fixed) and x between lo and hi")
        # a width in doubles: the range of a hash does not fit a long
        bins = F.expr(f"least(floor((cast(x as double) - cast(lo as double)) / ((cast(hi as double) - cast(lo as double) + 1) / {BINS})), {BINS - 1})")
        sums: dict[int, list[tuple]] = {i: [] for i in now}
        for r in rows.groupBy("node", bins.alias("bin")).agg(F.min("x"), F.max("x"), F.sum(weight)).collect():
            sums[r[0]].append(tuple(r[2:]))
        for i, s in now.items():
            acc, half = s["below"], s["total"] / 2
            for lo, hi, w in sorted(sums[i]):
                if acc + w >= half:
                    break
                acc += w
            miss, after = min((abs(acc - half), False), (abs(acc + w - half), True))
            edge = hi if after else lo - 1
            if miss <= TOLERANCE * s["total"]:
                cuts[i] = (edge, _TOP) if s["fixed"] is None else (s["fixed"], max(edge, -_TOP - 1))
            elif lo < hi:
                s |= {"lo": lo, "hi": hi, "below": acc}
            elif s["fixed"] is None:  # one value holds the middle: on to the hash among its rows
                s |= {"fixed": lo, "lo": -_TOP - 1, "hi": _TOP, "below": acc}
            else:  # one text holds the middle: it goes where the halves differ least
                cuts[i] = (s["fixed"], max(edge, -_TOP - 1))
    return cuts


def kd_tree(units: DataFrame, dims: Sequence[str], tie: str, weight: str, leaves: int) -> list[list[tuple[int, int, int, int]]]:
    """Levels of (node, dimension, value, tie value) of a tree of `leaves` leaves, a power of two, over long columns without nulls."""
    spans = [F.max(d) - F.min(d) for d in dims]
    whole = [max(1, x or 0) for x in units.agg(*spans).first()]
    rows, levels = units.withColumn("node", F.lit(0).cast("long")), []
    while 2 ** len(levels) < leaves:
        picked = {}
        for r in rows.groupBy("node").agg(*spans).collect():
            picked[r[0]] = max(range(len(dims)), key=lambda k: (r[k + 1] / whole[k], -k))
        cuts = _cuts(rows, picked, dims, tie, weight) if picked else {}
        # a node without rows splits anywhere
        levels.append([(i, picked.get(i, 0), *cuts.get(i, (0, 0))) for i in range(2 ** len(levels))])
        rows = _descend(rows, levels[-1], dims, tie)
    return levels


def kd_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every row.

    size: UTF-8 bytes plus 1 (null text: 1). Equal texts share a shard; a null text counts as
    empty. law is `bytes`: sizes are balanced as far as groups of equal texts allow, so a group above a
    shard's fair part makes its shard larger. shard: 0 to shards - 1, a power of two of them; slot: gapless from
    0 within a shard, by (lane, id, crc32). Null ids and repeated rows are rows like others.
    """
    if shards < 1 or shards & (shards - 1):
        raise ValueError("shards must be a power of two")
    raw = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw.cast("binary")).alias("text_crc32"), F.xxhash64(raw).alias("tie"))
    rows = materialise(rows)
    units = rows.groupBy("size", "text_crc32", "tie").agg(F.sum("size").alias("weight"))
    units = materialise(units)
    dims = ["size", "text_crc32"]
    tree = kd_tree(units, dims, "tie", "weight", shards)
    rows = rows.withColumn("node", F.lit(0).cast("long"))
    for level in tree:
        rows = _descend(rows, level, dims, "tie")
    rows = rows.withColumn("shard", F.col("node").cast("int")).withColumn("lane", F.expr(f"cast(pmod(xxhash64(doc_id, text_crc32), {LANES}) as int)"))
    # one row for each shard and lane: shards * LANES at most
    counts = rows.groupBy("shard", "lane").agg(F.count("*").alias("n"))
    start = F.sum("n").over(Window.partitionBy("shard").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("shard", "lane", F.coalesce(start, F.lit(0)).alias("start"))
    within = F.row_number().over(Window.partitionBy("shard", "lane").orderBy("doc_id", "text_crc32")) - 1
    out = rows.withColumn("within", within).join(F.broadcast(starts), ["shard", "lane"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("within")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

