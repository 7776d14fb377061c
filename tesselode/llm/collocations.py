"""Phrases of 2 to 4 words that hold together, by language: counts, scores of their loosest cut, the best of each language.

Levels of length k: a phrase is a candidate where the two phrases of k - 1 words in it are frequent
(Apriori), which mappers look up in a filter of bounded size that may err towards yes. A mapper sums the candidates
of its texts and sends keys and counts, packed, to the block of each key. A block's task puts its
candidates in a minimal perfect hash with the stored keys beside it, and bincounts what each mapper
sent into an array by slot. Blocks are as many as the counted words ask for, so none outgrows its task, and a
frequent word costs a block one entry from each mapper.

Keys are 64-bit hashes of language and words; counts are exact up to their collisions. Texts are read once
for each length, and once more for the wording of the phrases that lead.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import textcore as tc
from .runtime import attach, materialise, partitions, tune

LONGEST, LEAST, TOP = 4, 30, 2000
#: A candidate goes where a longer one has this share of its occurrences.
INSIDE = (80, 100)
SCALE = 2_000_000
#: Bytes of a chunk of text; texts are cut at ends of pieces alone.
CHUNK = 1 << 20
#: Sums a mapper holds before it sends them.
PENDING = 1 << 18
#: Word occurrences for each block.
BLOCK = 1 << 19
#: Bits of a filter: 16 for each key, at most 16 MB, of which a key sets PROBES; a fuller one lets more candidates through and loses none.
FILTER_BITS, FILTER_MOST, PROBES = 16, 27, 4
#: Parts of the sort of a language's phrases.
LANES = 64

STOP = np.zeros(256, bool)
STOP[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_MASK = np.where(STOP, np.uint8(32), np.uint8(97))
_MASK[[0x20, 0x09]] = 32
_STEP = 0x9E3779B97F4A7C15
#: Parts of a phrase of k words that its row names: the first 1 to k - 1 words, the last 1 to k - 1, the middle two of four.
PARTS = ["p1", "p2", "p3", "r1", "r2", "r3", "mid"]


def parts_of(k: int) -> list[str]:
    return [f"p{j}" for j in range(1, k)] + [f"r{j}" for j in range(1, k)] + (["mid"] if k == 4 else [])


class PerfectHash:
    """A minimal perfect hash over distinct 64-bit keys, in levels: a key's bit is set where it falls alone, others go on."""

    def __init__(self, keys: np.ndarray) -> None:
        self.levels, self.stored = [], np.zeros(len(keys), np.uint64)
        left, base = keys, 0
        while len(left):
            size = max(8, 2 * len(left))
            at = self._place(left, len(self.levels), size)
            alone = np.bincount(at, minlength=size) == 1
            rank = np.cumsum(alone) - 1 + base
            hit = alone[at]
            self.stored[rank[at[hit]]] = left[hit]
            self.levels.append((size, alone, rank))
            base += int(hit.sum())
            left = left[~hit]

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (tc.mix(keys + np.uint64(_STEP * (level + 1) % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for what is not among the stored keys."""
        out = np.full(len(keys), -1, np.int64)
        todo = np.arange(len(keys))
        for i, (size, alone, rank) in enumerate(self.levels):
            at = self._place(keys[todo], i, size)
            hit = alone[at]
            out[todo[hit]] = rank[at[hit]]
            todo = todo[~hit]
            if not len(todo):
                break
        known = np.flatnonzero(out >= 0)
        out[known[self.stored[out[known]] != keys[known]]] = -1
        return out


def chunks(raw: np.ndarray, at: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first document, bytes, offsets) of runs of text that end at the end of a document or of a piece."""
    s, n = 0, len(raw)
    while s < n:
        e = min(n, s + limit)
        if e < n:
            edge = int(at[np.searchsorted(at, e, "right") - 1])
            if edge > s:
                e = edge
            elif len(stops := np.flatnonzero(STOP[raw[s:e]])):
                e = s + int(stops[-1]) + 1
            else:
                end = int(at[np.searchsorted(at, e, "left")])
                ahead = np.flatnonzero(STOP[raw[e:end]])
                e = e + int(ahead[0]) + 1 if len(ahead) else end
        first, last = int(np.searchsorted(at, s, "right")) - 1, int(np.searchsorted(at, e, "left"))
        yield first, raw[s:e], np.clip(at[first : last + 1], s, e) - s
        s = e


class Words:
    """Words of a chunk: bounds, pieces, and keys of the phrases that begin at each."""

    def __init__(self, raw: np.ndarray, at: np.ndarray, langs: np.ndarray) -> None:
        """langs: a 64-bit hash of each document's language."""
        self.raw = tc.LOWER[raw]
        self.start, self.end, of = tc.word_bounds(_MASK[raw], at)
        self.doc = np.repeat(np.arange(len(at) - 1), np.diff(of))
        self.hash = tc.word_hashes(self.raw, self.start, self.end)
        # a stop between two words, or another document, parts them
        stops = np.cumsum(STOP[raw])[self.start] if len(self.start) else np.zeros(0, np.int64)
        self.joined = (np.diff(stops) == 0) & (np.diff(self.doc) == 0)
        self.keys = [tc.mix(self.hash ^ langs[self.doc]) if len(self.hash) else self.hash]

    def key(self, k: int) -> np.ndarray:
        """Keys of k words; those over a stop mean nothing."""
        while len(self.keys) < k:
            j = len(self.keys)
            n = max(0, len(self.hash) - j)
            self.keys.append(tc.mix(self.keys[-1][:n] * np.uint64(_STEP) + self.hash[j : j + n]))
        return self.keys[k - 1]

    def within(self, k: int) -> np.ndarray:
        """Whether k words from each on lie in one piece."""
        out = np.ones(max(0, len(self.hash) - k + 1), bool)
        for j in range(k - 1):
            out &= self.joined[j : j + len(out)]
        return out


def key_of(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Keys of phrases given as rows of word hashes, with the hash of each one's language: as Words.key has them."""
    key = tc.mix(words[0] ^ langs)
    for w in words[1:]:
        key = tc.mix(key * np.uint64(_STEP) + w)
    return key


def _probe(keys: np.ndarray, j: int, size: int) -> np.ndarray:
    """Place of a key's bit j among size, a power of two."""
    return (keys + (keys >> np.uint64(32) | np.uint64(1)) * np.uint64(j)) & np.uint64(size - 1)


def _known(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = np.arange(len(keys))
    for j in range(PROBES):
        bit = _probe(keys[at], j, len(bits) * 8)
        at = at[(bits[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & np.uint8(1) > 0]
    out = np.zeros(len(keys), bool)
    out[at] = True
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Words, list[str]]]:
    """Words of every chunk, and the language of each of its documents."""
    for batch in batches:
        langs = [x if x is not None else "und" for x in batch.column(0).to_pylist()]
        names = sorted(set(langs))
        hashed = dict(zip(names, _language_hashes(names), strict=True))
        raw, at = tc.texts_of(batch.column(1))
        for first, part, offsets in chunks(raw, at):
            own = langs[first : first + len(offsets) - 1]
            yield Words(part, offsets, np.array([hashed[x] for x in own], np.uint64)), own


def _language_hashes(names: list[str]) -> list[int]:
    raw, at = tc.texts_of(pa.array(names, pa.large_string()))
    return tc.mix(tc.word_hashes(raw, at[:-1], at[1:]) + np.uint64(1)).tolist() if len(raw) else [1] * len(names)


def _candidates(words: Words, k: int, bits: np.ndarray | None) -> np.ndarray:
    """Where phrases of k words begin whose parts of k - 1 words may be frequent."""
    ok = words.within(k)
    if bits is not None and len(ok):
        known = _known(bits, words.key(k - 1))
        ok &= known[: len(ok)] & known[1 : len(ok) + 1]
    return np.flatnonzero(ok)


class _Sums:
    """Counts by key that a mapper has pending, with the language and the words of each key."""

    def __init__(self, k: int, blocks: int) -> None:
        self.k, self.blocks, self.names, self.held, self.size = k, blocks, {}, [], 0

    def add(self, words: Words, i: np.ndarray, langs: list[str]) -> None:
        keys, first, n = np.unique(words.key(self.k)[i], return_index=True, return_counts=True)
        code = np.array([self.names.setdefault(x, len(self.names)) for x in langs], np.int64)
        at = i[first]
        self.held.append(np.vstack([keys, n.view(np.uint64), code[words.doc[at]].view(np.uint64), *[words.hash[at + j] for j in range(self.k)]]))
        self.size += len(keys)

    def merge(self) -> np.ndarray:
        rows = np.hstack(self.held)
        keys, first, back = np.unique(rows[0], return_index=True, return_inverse=True)
        n = np.bincount(back, weights=rows[1], minlength=len(keys))
        rows = rows[:, first]
        rows[1] = n.astype(np.uint64)
        self.held, self.size = [rows], len(keys)
        return rows

    def packed(self) -> pa.RecordBatch:
        """A row for each block that has keys; a key is not sent, as its words give it."""
        rows = self.merge()
        block = (tc.mix(rows[0]) % np.uint64(self.blocks)).astype(np.int64)
        order = np.argsort(block, kind="stable")
        rows, block = rows[:, order], block[order]
        edges = np.flatnonzero(np.diff(block, prepend=-1))
        langs, cuts = list(self.names), np.append(edges, len(block)).tolist()
        spans = list(zip(cuts, cuts[1:], strict=False))
        cols = [[rows[1, a:b].tobytes() for a, b in spans], [rows[2, a:b].astype(np.uint16).tobytes() for a, b in spans], [rows[3:, a:b].tobytes() for a, b in spans]]
        self.names, self.held, self.size = {}, [], 0
        return pa.RecordBatch.from_arrays([pa.array(block[edges], pa.int64()), pa.array([langs] * len(spans), pa.list_(pa.string())), *[pa.array(x, pa.binary()) for x in cols]], names=_SENT)


_SENT = ["block", "langs", "n", "lang", "words"]
#: Languages a mapper names by numbers of 16 bits before it sends what it has.
_LANGS_MOST = 1 << 15


def _mapper(k: int, blocks: int, filter_of: Callable[[], np.ndarray | None]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sums = filter_of(), _Sums(k, blocks)
        for words, langs in _texts(batches):
            if len(i := _candidates(words, k, bits)):
                sums.add(words, i, langs)
            if sums.size > 2 * PENDING:
                sums.merge()
            if sums.size > PENDING and len(sums.held) == 1 or len(sums.names) > _LANGS_MOST:
                yield sums.packed()
        if sums.size:
            yield sums.packed()

    return run


_FOUND = pa.schema([("k", pa.int32()), ("lang", pa.string()), ("key", pa.int64()), ("n", pa.int64()), *[(p, pa.int64()) for p in PARTS]])


def _counter(k: int, least: int):
    """Counts a block. Rows: its phrases of `least` occurrences or more; for words also one without key for all of a language."""

    def run(table: pa.Table) -> pa.Table:
        named = table.column("langs").to_pylist()
        names = sorted({n for own in named for n in own})
        place = {n: i for i, n in enumerate(names)}
        code = np.concatenate([np.array([place[n] for n in own], np.int64)[np.frombuffer(x, np.uint16)] for own, x in zip(named, table.column("lang").to_pylist(), strict=True)])
        sent = [np.frombuffer(x, np.uint64) for x in table.column("n").to_pylist()]
        words = np.hstack([np.frombuffer(x, np.uint64).reshape(k, -1) for x in table.column("words").to_pylist()])
        keys = key_of(words, np.array(_language_hashes(names), np.uint64)[code])
        slots_of = PerfectHash(np.unique(keys))
        m = len(slots_of.stored)
        counts, where, at = np.zeros(m, np.int64), np.zeros(m, np.int64), 0
        for n in sent:
            slot = slots_of.slots(keys[at : at + len(n)])
            counts += np.bincount(slot, weights=n, minlength=m).astype(np.int64)
            where[slot] = np.arange(at, at + len(n))
            at += len(n)
        often = where[counts >= least]
        words, code_of = words[:, often], code[often]
        langs = np.array(_language_hashes(names), np.uint64)[code_of]
        cols = {"k": np.full(len(often), k, np.int32), "lang": np.array(names, object)[code_of], "key": slots_of.stored[counts >= least].view(np.int64), "n": counts[counts >= least]}
        for p in parts_of(k):
            part = words[1:3] if p == "mid" else words[: int(p[1])] if p[0] == "p" else words[k - int(p[1]) :]
            cols[p] = key_of(part, langs).view(np.int64)
        out = pa.table([pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(len(often), f.type) for f in _FOUND], schema=_FOUND)
        if k > 1:
            return out
        total = np.bincount(code[where], weights=counts, minlength=len(names)).astype(np.int64)
        all_words = {"k": np.zeros(len(names), np.int32), "lang": names, "n": total}
        return pa.concat_tables([out, pa.table([pa.array(all_words[f.name], f.type) if f.name in all_words else pa.nulls(len(names), f.type) for f in _FOUND], schema=_FOUND)])

    return run


_FOUND_SQL = "k int, lang string, key long, n long, " + ", ".join(f"{p} long" for p in PARTS)


def _filter(keys: DataFrame) -> Callable[[], np.ndarray]:
    """A function for tasks that gives the bits of keys (key long). Bits are set in blocks of 32 KB; at most 16 MB come together."""
    spark = keys.sparkSession
    n = keys.count()
    size = min(max(int(n * FILTER_BITS).bit_length(), 18), FILTER_MOST)

    def fill(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << 18, np.uint8)
        bits[table.column("place").to_numpy() & ((1 << 18) - 1)] = 1
        return pa.table([table.column("block").slice(0, 1), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], names=["block", "bits"])

    places = [f"((key & {(1 << size) - 1}L) + (shiftrightunsigned(key, 32) | 1L) * {j}L) & {(1 << size) - 1}L" for j in range(PROBES)]
    placed = keys.select(F.explode(F.array(*[F.expr(p) for p in places])).alias("place")).withColumn("block", F.expr("place >> 18"))
    parts = placed.groupBy("block").applyInArrow(fill, "block long, bits binary").collect()
    whole = np.zeros((1 << size) // 8, np.uint8)
    for r in parts:
        whole[r.block << 15 : (r.block + 1) << 15] = np.frombuffer(r.bits, np.uint8)
    held = spark.sparkContext.broadcast(whole)
    return lambda: held.value


def _level(docs: DataFrame, k: int, blocks: int, least: int, filter_of: Callable[[], np.ndarray | None]) -> DataFrame:
    sent = docs.mapInArrow(_mapper(k, blocks, filter_of), "block long, langs array<string>, n binary, lang binary, words binary")
    if blocks > partitions(docs.sparkSession):
        sent = sent.repartition(blocks, "block")
    return materialise(sent.groupBy("block").applyInArrow(_counter(k, least), _FOUND_SQL))


def _spelled(docs: DataFrame, filter_of: Callable[[], np.ndarray]) -> DataFrame:
    """key, phrase of phrases that the filter may know; a mapper names each once for every PENDING of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, said = filter_of(), {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(said), pa.int64()), pa.array(list(said.values()), pa.binary())], names=["key", "phrase"])

        for words, _ in _texts(batches):
            for k in range(2, LONGEST + 1):
                i = np.flatnonzero(words.within(k))
                keys = words.key(k)[i]
                hit = np.flatnonzero(_known(bits, keys))
                found, first = np.unique(keys[hit], return_index=True)
                for key, w in zip(found.view(np.int64).tolist(), i[hit[first]].tolist(), strict=True):
                    if key not in said:
                        said[key] = b" ".join(words.raw[words.start[j] : words.end[j]].tobytes() for j in range(w, w + k))
            if len(said) > PENDING:
                yield out()
                said.clear()
        if said:
            yield out()

    spelled = docs.mapInArrow(run, "key long, phrase binary")
    return spelled.groupBy("key").agg(F.min("phrase").cast("string").alias("phrase"))


def _over(a: Column, whole: Column) -> Column:
    """floor(SCALE * a / whole), with the product beyond 64 bits."""
    return F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * a.cast("decimal(19,0)"), whole.cast("decimal(20,0)"))


def _first(rows: DataFrame, order: list[Column], top: int, ties: bool) -> DataFrame:
    """The first `top` rows of each language, with all that tie with the last of them or by row number; sorted by lanes first."""
    number = F.rank() if ties else F.row_number()
    lane = F.pmod(F.xxhash64("key"), F.lit(LANES))
    some = rows.withColumn("lane", lane).withColumn("rank", number.over(Window.partitionBy("lang", "lane").orderBy(*order))).where(F.col("rank") <= top).drop("lane")
    return some.withColumn("rank", number.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)


def collocations(docs: DataFrame, top: int = TOP, least: int = LEAST, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's first `top` phrases of 2 to 4 words.

    a, l, r: occurrences of the phrase and of the two sides of its loosest cut; n: words of the language. Only texts and
    languages are read: a null text is empty, a null language is `und`, repeated rows count each time, no rows give none.
    """
    if top < 1 or least < 1:
        raise ValueError("top and least must be 1 or more")
    spark = docs.sparkSession
    tune(spark)
    docs = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # a word takes two bytes at least: so many blocks hold the words of all texts, whatever they are
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(partitions(spark), -(-size // (6 * BLOCK)))
    levels = [_level(docs, 1, blocks, least, lambda: None)]
    for k in range(2, LONGEST + 1):
        levels.append(_level(docs, k, blocks, least, _filter(levels[-1].where("key is not null").select("key"))))
    totals = levels[0].where("key is null").groupBy("lang").agg(F.sum("n").alias("total"))
    known = levels[0].where("key is not null").select("key", "n")
    phrases = levels[1]
    for level in levels[2:]:
        phrases = phrases.unionByName(level)
    known = known.unionByName(phrases.select("key", "n"))
    # the fullest longer phrase around each, by its contiguous parts of two words or more
    inner = F.filter(F.array("p2", "p3", "r2", "r3", "mid"), lambda x: x.isNotNull())
    around = phrases.where("k > 2").select(F.explode(inner).alias("key"), "n").groupBy("key").agg(F.max("n").alias("longer"))
    share, of = INSIDE
    kept = phrases.join(around, "key", "left").where(F.col("longer").isNull() | (F.col("longer").cast("decimal(19,0)") * of < F.col("n").cast("decimal(19,0)") * share)).drop("longer")
    kept = materialise(kept)
    sides = F.array(*[F.struct(F.lit(p).alias("part"), F.col(p).alias("key")) for p in PARTS[:6]])
    asked = kept.select(F.col("key").alias("of"), F.explode(F.filter(sides, lambda x: x["key"].isNotNull())).alias("x")).select("of", "x.part", "x.key")
    asked = materialise(asked)
    wanted = materialise(known.join(asked.groupBy("key").agg(F.count("*").alias("asks")), "key"))
    told = attach(asked, wanted, ["key"], "asks").groupBy("of").agg(*[F.max(F.when(F.col("part") == p, F.col("n"))).alias(f"n_{p}") for p in PARTS[:6]])
    rows = kept.select("key", "lang", "k", F.col("n").alias("a")).join(told.withColumnRenamed("of", "key"), "key")
    cuts = []
    for j in range(1, LONGEST):
        right = F.element_at(F.array("n_r1", "n_r2", "n_r3"), F.greatest(F.col("k") - j, F.lit(1)))
        left = F.col(f"n_p{j}")
        cuts.append(F.when(F.col("k") > j, F.struct(_over(F.col("a"), left + right).alias("score"), F.lit(j).alias("at"), left.alias("l"), right.alias("r"))))
    rows = rows.withColumn("cut", F.array_min(F.filter(F.array(*cuts), lambda x: x.isNotNull()))).select("key", "lang", "a", "cut.l", "cut.r", "cut.score")
    ahead = materialise(_first(rows, [F.desc("score"), F.desc("a")], top, True).drop("rank"))
    named = ahead.join(_spelled(docs, _filter(ahead.select("key"))), "key")
    out = _first(named, [F.desc("score"), F.desc("a"), F.asc("phrase")], top, False)
    return out.join(F.broadcast(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), F.col("score").cast("long").alias("score"))
