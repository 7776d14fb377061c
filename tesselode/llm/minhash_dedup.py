"""Near-duplicate groups by SetSketch registers, banding, joint likelihood and exact verification.

A document is the set of its distinct word 5-grams. A register holds an exponentially spaced, truncated
minimum of the set's hashes: floor(1 - log_b(x)) of the least exponential variate x. Registers of a
union are the maxima, and two sets agree in one with a probability that rises with their
similarity. Documents with all registers of a band alike are candidates; the
counts of registers above, below and equal give the joint likelihood of the
similarity; what may reach the threshold is verified on the full sets.

Copies with equal sets are one node, and so are the sets of one id. A band's bucket first tries its members against the
least of them. In a bucket that still holds several components, members outside its largest component visit the
others, which lie in blocks of bounded size: first each visitor proposes its likeliest partners, all of which are verified. A visitor
with more plausible partners in a block than it proposed goes there again, where these pairs are tested in place and only
links leave the block. A pair is tested in the first band it shares.
A bucket of m near copies, r of them outside the largest component, is m + r * m / BLOCK rows: linear while most
hang together. No pair of different components that shares a band is left untested.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .components import components
from .repeats import _batch
from .runtime import attach, fresh, materialise, tune

WORDS, THRESHOLD = 5, (75, 100)
#: Base and rate of the registers, registers in all, registers of a band: 32 bands of 4 miss a pair of similarity 0.75 once in 200,000.
BASE, RATE, REGISTERS, ROWS = 1.001, 20.0, 128, 4
#: A pair stays unless the likelihood at the threshold is this many nats below its maximum (four standard errors).
NATS = 8.0
#: Partners a member proposes in the first comparison, the most alike; the second tests those of members that have more, in place.
BEST = 4
#: Members and shingles a comparison block aims at, and members that share a copy of their centre's set.
BLOCK, BLOCK_SHINGLES, STAR = 512, 250_000, 128

_rng = np.random.default_rng(7)
_MUL = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, REGISTERS, dtype=np.uint32)
_MUL2 = (_rng.integers(0, 1 << 31, REGISTERS, dtype=np.uint32) << np.uint32(1)) | np.uint32(1)


def shingle_sets(raw: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each document of a slice."""
    low = tc.LOWER[raw]
    start, end, of = tc.word_bounds(low, at)
    words = tc.word_hashes(low, start, end)
    sums = tc.prefix(words)
    out = []
    p = np.arange(max(0, len(words) - WORDS + 1))
    grams = tc.span(sums, p, p + WORDS) if len(p) else np.zeros(0, np.uint64)
    for lo, hi in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        if hi - lo >= WORDS:
            x = np.sort(grams[lo : hi - WORDS + 1])
            out.append(x[np.concatenate(([True], x[1:] != x[:-1]))])
        elif hi > lo:
            out.append(tc.span(sums, np.array([lo]), np.array([hi])) ^ tc.mix(np.array([hi - lo], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(x: np.ndarray) -> np.ndarray:
    """The registers of a set of hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    high, low = (x >> np.uint64(32)).astype(np.uint32), x.astype(np.uint32)
    for i in range(0, len(x), 4096):
        h = _MUL[:, None] * high[None, i : i + 4096]
        h += _MUL2[:, None] * low[None, i : i + 4096]
        least = np.minimum(least, (h + _ADD[:, None]).min(axis=1))
    u = (least.astype(np.float64) + 0.5) / 2.0**32
    k = np.floor(1 - np.log(-np.log1p(-u) / RATE) / math.log(BASE))
    return np.clip(k, 0, 65535).astype("<u2")


def plausible(n_a: np.ndarray, n_b: np.ndarray, above: np.ndarray, below: np.ndarray) -> np.ndarray:
    """Whether a similarity of the threshold or more fits the register counts. Sizes that rule it out do so exactly.

    Fewer than half of the registers equal lie 6.5 standard errors below the threshold's share and are not looked at.
    """
    n_a, n_b = np.asarray(n_a, float), np.asarray(n_b, float)
    out = (THRESHOLD[1] * np.minimum(n_a, n_b) >= THRESHOLD[0] * np.maximum(n_a, n_b)) & (2 * (REGISTERS - above - below) >= REGISTERS)
    i = np.flatnonzero(out)
    n_a, n_b, above, below = n_a[i], n_b[i], above[i], below[i]
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    top = np.minimum(u, v) / np.maximum(u, v)
    grid = np.linspace(0, 1, 81)[None, :]
    aim = THRESHOLD[0] / THRESHOLD[1]

    def likelihood(j: np.ndarray) -> np.ndarray:
        def p(x: np.ndarray) -> np.ndarray:
            return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / math.log(BASE)

        over, under = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
        same = np.maximum(1 - over - under, 1e-12)
        return above[:, None] * np.log(np.maximum(over, 1e-12)) + below[:, None] * np.log(np.maximum(under, 1e-12)) + (REGISTERS - above - below)[:, None] * np.log(same)

    best = likelihood(grid * top[:, None]).max(axis=1)
    near = likelihood(aim + grid * np.maximum(top - aim, 0)[:, None]).max(axis=1)
    out[i] = near >= best - NATS
    return out


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """Exact Jaccard test on sorted distinct hashes."""
    if THRESHOLD[1] * min(len(a), len(b)) < THRESHOLD[0] * max(len(a), len(b)):
        return False
    m = np.concatenate((a, b))
    m.sort(kind="stable")
    both = int((m[1:] == m[:-1]).sum())
    return THRESHOLD[1] * both >= THRESHOLD[0] * (len(a) + len(b) - both)


def _sketch_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "tx", "n", "s1", "s2", "sketch"]
    kinds = [*[pa.int64()] * 5, pa.binary()]
    for batch in batches:
        ids, tx, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for first, _, raw, at in tc.slices(batch.column(2)):
            for i, x in enumerate(shingle_sets(raw, at)):
                s = [int(tc.mix(x ^ np.uint64(c)).sum(dtype=np.uint64).astype(np.int64)) for c in (0x51ED270B, 0xA0761D6478BD642F)]
                rows.append((ids[first + i], tx[first + i], len(x), *s, sketch(x).tobytes() if len(x) else None))
        yield _batch(rows, names, kinds)


def _bands(regs: np.ndarray) -> np.ndarray:
    """Registers of documents, a band of four as one number."""
    return np.ascontiguousarray(regs).view("<u8").astype(np.uint64)


def _band_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, n = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        packed = _bands(np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(len(ids), REGISTERS))
        width = packed.shape[1]
        keys = tc.mix(packed ^ tc.mix(np.arange(1, width + 1, dtype=np.uint64))[None, :])
        columns = [pa.array(keys.ravel().astype(np.int64)), pa.array(np.tile(np.arange(width, dtype=np.int32), len(ids))), pa.array(np.repeat(ids, width)), pa.array(np.repeat(n, width))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "band", "id", "n"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["id", "n", "sketch", "grams"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()]
    for batch in batches:
        ids = batch.column(0).to_pylist()
        for first, _, raw, at in tc.slices(batch.column(1)):
            yield _batch([(ids[first + i], len(x), sketch(x).tobytes(), x.tobytes()) for i, x in enumerate(shingle_sets(raw, at)) if len(x)], names, kinds)


def _estimate_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, REGISTERS) for i in (4, 5))
        ok = plausible(batch.column(2).to_numpy(), batch.column(3).to_numpy(), (x > y).sum(axis=1), (x < y).sum(axis=1))
        yield batch.filter(pa.array(ok)).select([0, 1])


class _Home:
    """The members of a block, whom visitors are compared with."""

    def __init__(self, rows: list[tuple]) -> None:
        self.band = rows[0][3]
        self.ids, self.comps, self.rest, self.n = (np.array([r[k] for r in rows]) for k in (4, 5, 6, 7))
        self.regs = np.frombuffer(b"".join(r[8] for r in rows), "<u2").reshape(len(rows), REGISTERS)
        self.bands = _bands(self.regs)
        self.sets = [np.frombuffer(r[9], np.uint64) for r in rows] if len(rows[0]) > 9 else []
        self.now: dict[int, int] = {}  # components that joined another one here

    def meet(self, row: tuple, best: int | None) -> list[tuple[int, int]]:
        """Pairs of a visitor and members of other components: the likeliest, or, without best, those that are linked. A last pair with None tells of more than best."""
        i, comp, n = row[4], self.now.get(row[5], row[5]), row[7]
        regs = np.frombuffer(row[8], "<u2")
        o = np.flatnonzero((self.comps != comp) & (~self.rest | (self.ids < i)))
        if not len(o):
            return []
        # each pair is met in the first band that both share
        o = o[(self.bands[o] == _bands(regs)[None, :]).argmax(axis=1) == self.band]
        x = self.regs[o]
        above, below = (x > regs).sum(axis=1), (x < regs).sum(axis=1)
        fit = np.flatnonzero(plausible(self.n[o], np.full(len(o), n), above, below))
        o = o[fit[np.argsort((above + below)[fit], kind="stable")]]
        if best is not None:
            return [(int(i), int(q)) for q in self.ids[o[:best]]] + [(int(i), None)] * (len(o) > best)
        own, out = np.frombuffer(row[9], np.uint64), []
        for q in o:
            if self.comps[q] != comp and linked(own, self.sets[q]):
                out.append((int(i), int(self.ids[q])))
                other = int(self.comps[q])
                self.comps[self.comps == comp] = other
                for k in [k for k, v in self.now.items() if v == comp]:
                    self.now[k] = other
                self.now[comp] = comp = other
        return out


def _compare_rows(batches: Iterator[pa.RecordBatch], best: int | None) -> Iterator[pa.RecordBatch]:
    """Over (key, block, role, band, id, comp, rest, n, sketch[, grams]) sorted: a block's members first, which are held, then its visitors one by one."""
    key, members, home = None, [], None
    for batch in batches:
        out: list[tuple] = []
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[:2] != key:
                key, members, home = row[:2], [], None
            if row[2] == 0:
                members.append(row)
                continue
            if home is None and members:
                home, members = _Home(members), []
            if home is not None:
                out += [(*pair, *row[:2]) for pair in home.meet(row, best)]
        if out:
            yield _batch(out, ["a", "b", "key", "block"], [pa.int64(), pa.int64(), pa.int64(), pa.int32()])


def _verify_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (a, salt, role, id, grams) sorted: the centre's sets first, then its members one by one."""
    key, centre = None, []
    for batch in batches:
        out = []
        for a, salt, role, i, grams in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (a, salt) != key:
                key, centre = (a, salt), []
            x = np.frombuffer(grams, np.uint64)
            if role == 0:
                centre.append(x)
            elif any(linked(c, x) for c in centre):
                out.append((a, i))
        if out:
            yield _batch(out, ["a", "b"], [pa.int64(), pa.int64()])


def _estimate(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    slim = sets.select("id", "n", "sketch")
    counts = materialise(pairs.groupBy(F.col("a").alias("id")).agg(F.count("*").alias("pairs")).join(slim, "id").toDF("a", "pairs", "n_a", "sk_a"))
    x = attach(pairs, counts, ["a"], "pairs").join(slim.toDF("b", "n_b", "sk_b"), "b")
    return x.select("a", "b", "n_a", "n_b", "sk_a", "sk_b").mapInArrow(_estimate_rows, "a long, b long").distinct()


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are linked. A centre's set goes once to every STAR of its members."""
    pairs = materialise(pairs)
    counts = materialise(pairs.groupBy("a").agg(F.count("*").alias("pairs")).withColumn("stars", F.ceil(F.col("pairs") / STAR).cast("int")))
    members = attach(pairs, counts, ["a"], "pairs").select("a", F.expr("pmod(xxhash64(b), stars)").alias("salt"), F.lit(1).alias("role"), F.col("b").alias("id"))
    centres = counts.select("a", F.explode(F.expr("sequence(0L, stars - 1L)")).alias("salt"), F.lit(0).alias("role"), F.col("a").alias("id"))
    rows = members.unionByName(centres).join(sets.select("id", "grams"), "id").select("a", "salt", "role", "id", "grams")
    return rows.repartition("a", "salt").sortWithinPartitions("a", "salt", "role").mapInArrow(_verify_rows, "a long, b long")


def _members(live: DataFrame, comps: DataFrame) -> DataFrame:
    """(key, band, id, rest, blocks, block) of buckets of more than two that hold several components; rest: outside the largest of them."""
    joined = live.where("m > 2").join(comps, "id", "left").select("key", "band", "id", "n", "m", F.coalesce("component", "id").alias("comp"))
    parts = joined.groupBy("key", "band", "m", "comp").agg(F.count("*").alias("k"), F.sum("n").alias("w"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("sig"))
    buckets = parts.groupBy("key", "band", "m").agg(F.max(F.struct("k", "comp")).alias("most"), F.sum("w").alias("w"), F.sum("sig").alias("sig"), F.count("*").alias("parts")).where("parts > 1")
    # of buckets with the same members that of the least band stays: it is the first that its pairs share
    chosen = buckets.groupBy("sig", "m").agg(F.min(F.struct("band", "key", "most", "w")).alias("x"))
    blocks = F.greatest(F.ceil(F.col("m") / BLOCK), F.ceil(F.col("x.w") / BLOCK_SHINGLES)).cast("int")
    chosen = chosen.select("x.key", F.col("x.most.comp").alias("most"), blocks.alias("blocks"))
    rest = (F.col("comp") != F.col("most")).alias("rest")
    return joined.join(chosen, "key").select("key", "band", "id", rest, "blocks", F.expr("cast(pmod(xxhash64(id), blocks) as int)").alias("block"))


def _proposed(members: DataFrame, visits: DataFrame, sets: DataFrame, comps: DataFrame, best: int | None) -> DataFrame:
    """(a, b, key, block): pairs of different components that visits(key, band, id, rest, block) find in their blocks of members: see _compare_rows."""
    columns = ["n", "sketch"] + ["grams"] * (best is None)
    home = members.select("key", "band", "id", "rest", "block")
    rows = home.withColumn("role", F.lit(0)).unionByName(visits.withColumn("role", F.lit(1))).join(comps, "id", "left")
    rows = rows.join(sets.select("id", *columns), "id").select("key", "block", "role", "band", "id", F.coalesce("component", "id").alias("comp"), "rest", *columns)
    rows = rows.repartition("key", "block").sortWithinPartitions("key", "block", "role")
    return rows.mapInArrow(lambda batches: _compare_rows(batches, best), "a long, b long, key long, block int")


def _grouped(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, tx (hash of the text), n, component_id of every row of docs: see near_duplicates."""
    tune(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("tx"), F.col(text_col).alias("text"))
    rows = materialise(own.mapInArrow(_sketch_rows, "doc_id long, tx long, n long, s1 long, s2 long, sketch binary"))
    full = rows.where("n > 0 and doc_id is not null")
    nodes = materialise(full.groupBy("n", "s1", "s2").agg(F.min("doc_id").alias("id"), F.first("sketch").alias("sketch"), F.count("*").alias("copies")))
    bands = nodes.select("id", "n", "sketch").mapInArrow(_band_rows, "key long, band int, id long, n long")
    crowded = bands.groupBy("key").agg(F.min("id").alias("c"), F.count("*").alias("m")).where("m > 1")
    live = materialise(bands.join(crowded, "key"))
    key = F.struct("n", "s1", "s2")
    repeated = materialise(full.groupBy("doc_id").agg(F.min(key).alias("x"), F.max(key).alias("y"), F.count("*").alias("rows")).where("rows > 1"))
    again = not repeated.isEmpty()
    ids = live.select("id").distinct()
    texts = own.where("doc_id is not null").join(ids, own["doc_id"] == ids["id"])
    texts = (texts.dropDuplicates(["doc_id", "tx"]) if again else texts).select("doc_id", "text")
    sets = materialise(texts.mapInArrow(_set_rows, "id long, n long, sketch binary, grams binary"))
    tried = materialise(live.where("id <> c").select(F.col("c").alias("a"), F.col("id").alias("b")).distinct())
    links = _verify(_estimate(tried, sets), sets)

    if again:  # ids with several sets, each of which hangs on the id
        several = full.join(repeated.where("x <> y").select("doc_id"), "doc_id", "left_semi").select("doc_id", "n", "s1", "s2").distinct()
        links = links.unionByName(several.join(nodes, ["n", "s1", "s2"]).select(F.col("doc_id").alias("a"), F.col("id").alias("b")))
    first = components(links)

    tried = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
    members = materialise(_members(live, first))
    visits = members.where("rest").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)"))).drop("blocks")
    for best in (BEST, None):
        told = materialise(_proposed(members, visits, sets, first, best))
        more = told.where("b is not null").select("a", "b").distinct()
        if best is not None:
            more = _verify(more.join(tried, ["a", "b"], "left_anti"), sets)
            # what is left: visitors with more plausible partners in a block than were verified
            left = told.where("b is null").select(F.col("a").alias("id"), "key", "block")
            visits = left.join(members.select("id", "key", "band", "rest"), ["id", "key"])
            members = members.join(left.select("key", "block").distinct(), ["key", "block"], "left_semi")
        more = materialise(more)
        if more.isEmpty():
            continue
        more = more.join(first.toDF("a", "ca"), "a", "left").join(first.toDF("b", "cb"), "b", "left")
        second = components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")).distinct())
        # nodes of the components that moved, and those least nodes that had no row of their own
        moved = first.join(second.toDF("component", "c2"), "component", "left").select("id", F.coalesce("c2", "component").alias("component"))
        first = materialise(moved.unionByName(second.join(first.select("id"), "id", "left_anti")))

    groups = nodes.select("n", "s1", "s2", "id", "copies").join(first, "id", "left").select("n", "s1", "s2", "copies", F.coalesce("component", "id").alias("found"))
    out = attach(rows.drop("sketch"), materialise(groups), ["n", "s1", "s2"], "copies", "left")
    return out.select("doc_id", "tx", "n", F.when(F.col("doc_id").isNotNull(), F.coalesce("found", "doc_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs.

    Linked: 100 * intersection >= 75 * union of the 5-word shingle sets (A-Z in lower case); a text of
    1 to 4 words is one shingle; null, empty or blank texts have no shingles and no links. component_id is the
    smallest id reachable; kept: it is the row's own. A null id is never linked: null component, kept.
    Rows that share an id are one document: its texts are linked with each other, but for those without shingles.
    Other columns of docs are not looked at. An empty table gives no rows.
    """
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept")
    return _grouped(docs, id_col, text_col).select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of near duplicates, with all columns of docs, whatever their names.

    It is the row of the smallest id; if that id has several texts, the one with the most shingles, then the
    smallest hash; of rows that repeat id and text any one. Rows without shingles are in no group: each
    distinct (id, text) of them stays once. Rows with a null id all stay.
    """
    verdict = _grouped(docs, id_col, text_col).where("doc_id = component_id")
    best = verdict.where("n > 0").groupBy("doc_id").agg(F.max(F.struct("n", F.bitwise_not("tx").alias("t"))).alias("x")).select("doc_id", F.bitwise_not("x.t").alias("tx"))
    key = fresh(docs, "key")
    marked = docs.withColumn(key, F.xxhash64(text_col))
    i, t = fresh(marked, "stay_id"), fresh(marked, "stay_tx")
    stay = best.unionByName(verdict.where("n = 0").select("doc_id", "tx").distinct()).toDF(i, t)
    with_id = marked.where(F.col(id_col).isNotNull()).join(stay, (F.col(id_col) == F.col(i)) & (F.col(key) == F.col(t)), "left_semi")
    return with_id.dropDuplicates([id_col, key]).unionByName(marked.where(F.col(id_col).isNull())).select(docs.columns)
