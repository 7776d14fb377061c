"""Packing token ids into sequences by cutting-stock column generation.

A document is full sequences and a rest, which stays whole unless it is a filler. Rests have 32 lengths, in units of 64
ids rounded up, so the table of how many documents have which is a cutting-stock demand of 32 rows whatever the corpus:
a linear program over patterns of lengths, new patterns priced by a knapsack dynamic program until none
improves. Patterns rounded down serve whole ranges of ranked documents by arithmetic; the few rests left over are packed
first-fit decreasing. Fillers are the least share of rests, those of documents that are cut anyway first, whose ids
are as many as the gaps that all others leave. They form one stream that is cut at the edges of the gaps; what is left
of it fills sequences of its own and ends at powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .repeats import _batch
from .runtime import materialise, partitions, tune

SEQUENCE, UNIT, END_ID = 2048, 64, 1
UNITS = SEQUENCE // UNIT
#: Groups of documents, by hash, that become fillers together; ids of a stretch of the stream of fillers.
GROUPS, STRETCH = 256, 4096


# ---- the plan, on the driver: its size depends on the number of lengths, never on rows


def best_pattern(worth: np.ndarray) -> tuple[float, np.ndarray]:
    """Unbounded knapsack: counts of lengths 1..n (in units) within UNITS that are worth most."""
    n = len(worth)
    value, choice = np.zeros(UNITS + 1), np.full(UNITS + 1, -1)
    for room in range(1, UNITS + 1):
        value[room] = value[room - 1]
        for c in range(min(n, room)):
            if value[room - c - 1] + worth[c] > value[room] + 1e-12:
                value[room], choice[room] = value[room - c - 1] + worth[c], c
    counts, room = np.zeros(n), UNITS
    while room > 0:
        if choice[room] < 0:
            room -= 1
        else:
            counts[choice[room]] += 1
            room -= choice[room] + 1
    return float(value[UNITS]), counts


def cutting_stock(demand: Sequence[int], rounds: int = 5000) -> list[tuple[np.ndarray, float]]:
    """(pattern, times) of an optimal linear program: least sequences, every demand met exactly."""
    n = len(demand)
    basis = np.diag([float(UNITS // (c + 1)) for c in range(n)])
    times = np.asarray(demand, float) / basis.diagonal()
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        value, entering = best_pattern(np.ones(n) @ inverse)
        if value <= 1 + 1e-9:
            break
        step = inverse @ entering
        ratio = np.where(step > 1e-9, times / np.where(step > 1e-9, step, 1), np.inf)
        leaving = int(ratio.argmin())
        times = np.maximum(times - ratio[leaving] * step, 0)
        times[leaving] = ratio[leaving]
        basis[:, leaving] = entering
    return [(basis[:, k].astype(int), float(times[k])) for k in range(n)]


def plan(demand: Sequence[int]) -> tuple[list[tuple[int, np.ndarray]], list[list[int]]]:
    """Patterns with whole numbers of uses, and the sequences of left-over heads as lists of lengths in units."""
    left, out = np.asarray(demand, np.int64).copy(), []
    for pattern, times in cutting_stock(demand):
        # never more than the demand: a solution may lie a rounding error above a whole number
        uses = min([int(times + 1e-6), *(int(left[c] // pattern[c]) for c in np.flatnonzero(pattern))])
        if uses > 0 and pattern.any():
            left -= uses * pattern
            out.append((uses, pattern))
    bins: list[list[int]] = []
    for c in range(len(left), 0, -1):
        for _ in range(int(left[c - 1])):
            home = next((b for b in bins if sum(b) + c <= UNITS), None)
            if home is None:
                bins.append([c])
            else:
                home.append(c)
    return out, bins


def fillers(counts: np.ndarray, ids: np.ndarray) -> int:
    """How many of the groups are fillers, from the first on: no fewer ids than the others' gaps, by bisection.

    counts: rests by (group, length in units - 1); ids: the ids of a group's rests. All groups leave no gap.
    """
    low, high = 0, len(ids)
    while low < high:
        k = (low + high) // 2
        patterns, bins = plan(counts[k:].sum(axis=0))
        gaps = SEQUENCE * (sum(uses for uses, _ in patterns) + len(bins)) - int(ids[k:].sum())
        low, high = (low, k) if ids[:k].sum() >= gaps else (k + 1, high)
    return low


# ---- token ids of whole texts, one pass


def _token_rows(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.of(path)
        names = ["doc_id", "doc_tokens", "full", "rest", "rest_crc", "rest_ids", "order"]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        for batch in batches:
            ids, order = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for first, flat, at in encoder.encode_column(batch.column(1)):
                rows = []
                for i in range(len(at) - 1):
                    x = np.append(flat[at[i] : at[i + 1]], end_id).astype("<u4")
                    n = len(x) // SEQUENCE
                    full = [zlib.crc32(x[k * SEQUENCE : (k + 1) * SEQUENCE].tobytes()) for k in range(n)]
                    rest = x[n * SEQUENCE :].tobytes()
                    rows.append((ids[first + i], len(x), full, len(rest) // 4, zlib.crc32(rest), rest, order[first + i]))
                yield _batch(rows, names, kinds)

    return run


def _inline(spark: SparkSession, rows: Sequence[tuple], columns: str, width: int) -> DataFrame:
    """A few whole numbers as a table to broadcast."""
    rows = list(rows)
    text = ", ".join("(" + ", ".join(f"{int(x)}L" for x in r) + ")" for r in rows or [(0,) * width])
    df = spark.sql(f"SELECT * FROM VALUES {text} AS t({columns})")
    return F.broadcast(df if rows else df.where("false"))


def pack(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A document's ids are those of the tokenizer file, then end_id; each lies in one piece. Null text: empty, so end_id alone.
    Null ids and repeated rows are documents like others. Sequences hold SEQUENCE ids at most.
    """
    spark = docs.sparkSession
    tune(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("order"))
    tokens = rows.mapInArrow(_token_rows(tokenizer, end_id), "doc_id long, doc_tokens long, full array<long>, rest long, rest_crc long, rest_ids binary, order long")
    lanes = max(64, 4 * partitions(spark))
    dealt = F.xxhash64("doc_id", "order")
    d = tokens.withColumns({"lane": F.pmod(dealt, F.lit(lanes)), "n_full": F.size("full").cast("long"), "units": F.ceil(F.col("rest") / UNIT)})
    d = materialise(d.withColumn("group", F.pmod(F.shiftright(dealt, 32), F.lit(GROUPS)) + F.when(F.col("n_full") > 0, 0).otherwise(GROUPS)))
    keep = ["doc_id", "doc_tokens"]

    # what is planned with: at most 2 * GROUPS * UNITS rows
    counts, ids = np.zeros((2 * GROUPS, UNITS), np.int64), np.zeros(2 * GROUPS, np.int64)
    for r in d.where("rest > 0").groupBy("group", "units").agg(F.count("*").alias("n"), F.sum("rest").alias("ids")).collect():
        counts[r["group"], r["units"] - 1] = r["n"]
        ids[r["group"]] += r["ids"]
    cut = fillers(counts, ids)
    patterns, bins = plan(counts[cut:].sum(axis=0))

    # full sequences: a row for each lane says where its first one is
    before = Window.orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    by_rank = Window.partitionBy("lane").orderBy("doc_id", "order").rowsBetween(Window.unboundedPreceding, -1)
    filler = (F.col("group") < cut) & (F.col("rest") > 0)
    by_lane = materialise(d.groupBy("lane").agg(F.sum("n_full").alias("f"), F.sum(F.when(filler, F.col("rest")).otherwise(0)).alias("t")))
    full_at = by_lane.agg(F.coalesce(F.sum("f"), F.lit(0))).first()[0]
    lane_rows = by_lane.select("lane", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(name) for c, name in (("f", "full_at"), ("t", "filler_at"))))
    full = d.where("n_full > 0").select(*keep, "lane", "order", "n_full", "full").join(lane_rows, "lane")
    full = full.withColumn("full_seq", F.col("full_at") + F.coalesce(F.sum("n_full").over(by_rank), F.lit(0)))
    full = full.select(*keep, "full_seq", F.posexplode("full").alias("k", "ids_crc32"))
    full = full.select(*keep, (F.col("k") * SEQUENCE).cast("long").alias("start"), F.lit(SEQUENCE).cast("long").alias("length"), "ids_crc32", (F.col("full_seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))

    # whole rests: patterns are disjoint ranges of the ranks of a length, at most 2 * 32 * 32 rows in all
    next_seq, used, slots = full_at, [0] * UNITS, []
    for uses, p in [*patterns, *((1, np.bincount(b, minlength=UNITS + 1)[1:]) for b in bins)]:
        for c in np.flatnonzero(p):
            n = int(p[c])
            slots.append((c + 1, used[c], used[c] + uses * n, next_seq, n))
            used[c] += uses * n
        next_seq += uses
    own = d.where(~filler & (F.col("rest") > 0))
    by_units = materialise(own.groupBy("units", "lane").agg(F.count("*").alias("n")))
    rank_at = by_units.select("units", "lane", F.coalesce(F.sum("n").over(Window.partitionBy("units").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("rank_at"))
    rest = own.select(*keep, "order", "lane", "units", "rest", "rest_crc").withColumn("r", F.row_number().over(Window.partitionBy("lane", "units").orderBy("doc_id", "order")) - 1)
    rest = rest.join(rank_at, ["units", "lane"]).withColumn("rank", F.col("rank_at") + F.col("r"))
    table = _inline(spark, slots, "c, rank_from, rank_to, seq, n", 5)
    rest = rest.join(table, (F.col("units") == F.col("c")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    rest = rest.withColumn("sequence_id", F.col("seq") + F.floor((F.col("rank") - F.col("rank_from")) / F.col("n")))
    in_seq = Window.partitionBy("sequence_id").orderBy(F.desc("units"), "rank")
    rest = rest.select(
        *keep,
        (F.col("doc_tokens") - F.col("rest")).alias("start"),
        F.col("rest").alias("length"),
        F.col("rest_crc").alias("ids_crc32"),
        "sequence_id",
        (F.sum("rest").over(in_seq) - F.col("rest")).alias("offset"),
        F.sum("rest").over(Window.partitionBy("sequence_id")).alias("used"),
    )
    rest = materialise(rest)

    # gaps in the order of sequences, as ranges of the fillers' stream; behind them sequences of fillers alone
    gaps = rest.where(F.col("offset") + F.col("length") == F.col("used")).select("sequence_id", F.col("used").alias("at"), (SEQUENCE - F.col("used")).alias("room")).where("room > 0")
    gaps = gaps.withColumn("lane", F.floor((F.col("sequence_id") - full_at) / max(1, -(-(next_seq - full_at) // lanes))))
    gap_at = gaps.groupBy("lane").agg(F.sum("room").alias("n")).select("lane", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("gap_at"))
    by_seq = Window.partitionBy("lane").orderBy("sequence_id").rowsBetween(Window.unboundedPreceding, -1)
    gaps = gaps.join(gap_at, "lane").select("sequence_id", "at", "room", (F.col("gap_at") + F.coalesce(F.sum("room").over(by_seq), F.lit(0))).alias("g"))
    pos, end = SEQUENCE * (next_seq - full_at) - int(ids[cut:].sum()), int(ids[:cut].sum())
    extra = [(pos, SEQUENCE, (end - pos) // SEQUENCE, next_seq)]
    pos, next_seq = pos + extra[0][2] * SEQUENCE, next_seq + extra[0][2]
    for k in reversed(range(SEQUENCE.bit_length())):
        if end - pos >= 1 << k:
            extra.append((pos, 1 << k, 1, next_seq))
            pos, next_seq = pos + (1 << k), next_seq + 1
    more = _inline(spark, [x for x in extra if x[2] > 0], "p, room, n, seq", 4).withColumn("k", F.explode(F.expr("sequence(0L, n - 1)")))
    gaps = gaps.unionByName(more.select((F.col("seq") + F.col("k")).alias("sequence_id"), F.lit(0).cast("long").alias("at"), "room", (F.col("p") + F.col("k") * F.col("room")).alias("g")))

    # a gap and a filler span at most two stretches of the stream each; they meet in the one where both have begun
    stream = d.where(filler).select(*keep, "order", "lane", "rest", "rest_ids").join(lane_rows, "lane")
    stream = stream.withColumn("s", F.col("filler_at") + F.coalesce(F.sum("rest").over(by_rank), F.lit(0)))
    stream = stream.withColumn("stretch", F.explode(F.expr(f"sequence(s div {STRETCH}, (s + rest - 1) div {STRETCH})")))
    gaps = gaps.withColumn("stretch", F.explode(F.expr(f"sequence(g div {STRETCH}, (g + room - 1) div {STRETCH})")))
    piece = stream.join(gaps, "stretch").withColumns({"p": F.greatest("s", "g"), "q": F.least(F.col("s") + F.col("rest"), F.col("g") + F.col("room"))})
    piece = piece.where((F.col("p") < F.col("q")) & (F.col("stretch") == F.expr(f"p div {STRETCH}")))
    piece = piece.select(
        *keep,
        (F.col("doc_tokens") - F.col("rest") + F.col("p") - F.col("s")).alias("start"),
        (F.col("q") - F.col("p")).alias("length"),
        F.expr("crc32(substring(rest_ids, cast((p - s) * 4 + 1 as int), cast((q - p) * 4 as int)))").alias("ids_crc32"),
        "sequence_id",
        (F.col("at") + F.col("p") - F.col("g")).alias("offset"),
    )
    order = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return full.select(order).unionByName(rest.select(order)).unionByName(piece.select(order))
