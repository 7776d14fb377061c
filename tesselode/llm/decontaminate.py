"""Benchmark decontamination: a BM25 inverted index of test items with block maxima, then exact overlap.

The items are an inverted index: for each term its postings (item, impact), cut into blocks of items with the largest
impact of each, and its largest impact of all. Each passage of each document is a query for all items that reach
the threshold, a part of the item's score against itself. As in WAND, terms in rising order of their largest impact
are passed over until their sum reaches the threshold; from this pivot on a term is essential, as an item without
any of them cannot get there. Only blocks that hold an essential term are looked at, only those whose sum of block
maxima reaches the threshold are opened, and only there postings are read and items scored. Passages are wide
enough for the longest item. A retrieved item is then held against windows of twice its own length: it leaks if one reaches
the threshold and holds 0.75 or more of its 5-word shingles and half or more of the words both of its
question and of its answer: the last sentence, or the last third of an item of one sentence.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .repeats import _batch
from .runtime import fresh, tune
from .terms import Vocabulary, lowered, term_bounds

K1, B = 1.2, 0.75
#: Part of an item's own score that retrieves it, shingle containment, words of question and answer.
RETRIEVE, CONTAIN, PART = 0.5, 0.75, 0.5
WORDS, BLOCK = 5, 16
#: Bytes of items an index holds; more items make more indexes, each of which all documents pass. Statistics are those of all items.
SHARD_BYTES = 32 << 20
#: Bounds of up to this many (term, block) pairs are kept as a matrix, which gives the same sums with fewer look-ups.
MATRIX = 1 << 21
EPS = 1e-4


def _item_words(texts: list[str]) -> Iterator[tuple[np.ndarray, int]]:
    """Word hashes of each item, and the number of words of its question."""
    for _, _, raw, at in tc.slices(lowered(pa.array(texts, pa.large_string()))):
        start, end, of = term_bounds(raw, at)
        words = tc.word_hashes(raw, start, end)
        for i, (lo, hi) in enumerate(zip(of[:-1], of[1:], strict=True)):
            body = raw[at[i] : at[i + 1]].tobytes().rstrip(b" \n.?!")
            cut = max(body.rfind(x) for x in (b". ", b"? ", b"! ", b".\n", b"?\n"))
            n = int(hi - lo)
            first = int(np.searchsorted(start[lo:hi], at[i] + cut)) if cut > 0 else n - n // 3
            yield words[lo:hi], min(max(first, 1), max(n - 1, 1))


def _runs(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)


def _spread(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places lo[0] .. lo[0] + n[0] - 1, lo[1] .., end to end."""
    return np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


class ItemIndex:
    """Postings of items by term, in order of items, with block and list maxima of the impacts, as parts of the items' own scores.

    all_items, mean and longest are the number of items, their mean and largest length, df the documents of each term;
    those of `items` if not given.
    """

    def __init__(self, items: list[tuple[int, str]], all_items: int | None = None, mean: float | None = None, longest: int | None = None, df: dict[str, np.ndarray] | None = None) -> None:
        self.ids = [i for i, _ in items]
        parts = list(_item_words([t for _, t in items]))
        size = np.array([len(w) for w, _ in parts], np.int64)
        self.of = np.concatenate(([0], np.cumsum(size)))
        self.flat = np.concatenate([w for w, _ in parts]) if parts else np.zeros(0, np.uint64)
        self.answers = [c for _, c in parts]
        n = len(items) if all_items is None else all_items
        mean = float(size.mean()) if mean is None and len(size) else mean or 0.0
        self.longest = max(1, int(size.max(initial=0)) if longest is None else longest)
        self.vocabulary = Vocabulary(np.unique(self.flat))
        terms = self.vocabulary.hashes
        pair, tf = np.unique(np.searchsorted(terms, self.flat) * max(len(items), 1) + np.repeat(np.arange(len(items)), size), return_counts=True)
        term, self.item = pair // max(len(items), 1), (pair % max(len(items), 1)).astype(np.int32)
        del pair
        count = np.bincount(term, minlength=len(terms))
        if df is not None:
            order = np.argsort(df["term"])
            count = df["n"][order][np.searchsorted(df["term"][order], terms)] if len(terms) else count
        idf = np.log(1 + (n - count + 0.5) / (count + 0.5))
        impact = idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size[self.item] / max(mean, 1e-9)))
        own = np.bincount(self.item, impact, len(items))
        self.impact = (impact / np.where(own > 0, own, 1)[self.item]).astype(np.float32)
        self.blocks = max(1, -(-len(items) // BLOCK))
        key = term * self.blocks + self.item // BLOCK
        self.first = np.append(_runs(key), len(key))  # the first posting of each (term, block)
        self.key = key[self.first[:-1]]
        self.most = np.maximum.reduceat(self.impact, self.first[:-1]) if len(key) else self.impact
        self.at = np.searchsorted(self.key, np.arange(len(terms) + 1) * self.blocks)  # the first block of each term
        self.top = np.maximum.reduceat(self.most, self.at[:-1]) if len(terms) else self.most
        self.matrix = self.slot = None
        if len(terms) * self.blocks <= MATRIX:
            self.slot = np.full((len(terms), self.blocks), -1, np.int32)
            self.slot[self.key // self.blocks, self.key % self.blocks] = np.arange(len(self.key))
            self.matrix = np.zeros((len(terms), self.blocks), np.float32)
            self.matrix[self.key // self.blocks, self.key % self.blocks] = self.most
        self.term, self.by_item = term.astype(np.int32), np.argsort(self.item, kind="stable").astype(np.int32)
        self.item_at = np.searchsorted(self.item[self.by_item], np.arange(len(items) + 1))
        self._grams: dict[int, np.ndarray] = {}

    def held(self, term: np.ndarray, block: np.ndarray) -> np.ndarray:
        """The number of each (term, block) among those with postings, or -1."""
        if self.slot is not None:
            return self.slot[term, block]
        want = term * self.blocks + block
        k = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
        return np.where(self.key[k] == want, k, -1)

    def retrieved(self, begin: np.ndarray, end: np.ndarray, groups: np.ndarray, blocks: np.ndarray, term: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(number of passage, item, score) of all items of open blocks that reach the threshold."""
        for c in range(0, len(groups), 2048):
            g, block = groups[c : c + 2048], blocks[c : c + 2048]
            n = end[g] - begin[g]
            at = np.repeat(np.arange(len(g)), n)
            k = self.held(term[_spread(begin[g], n)], block[at])
            at, k = at[k >= 0], k[k >= 0]
            size = self.first[k + 1] - self.first[k]
            posts = _spread(self.first[k], size)
            at = np.repeat(at, size)
            scores = np.bincount(at * BLOCK + self.item[posts] - block[at] * BLOCK, self.impact[posts], len(g) * BLOCK)
            for x in np.flatnonzero(scores >= RETRIEVE):
                yield int(g[x // BLOCK]), int(block[x // BLOCK] * BLOCK + x % BLOCK), float(scores[x])

    def open_blocks(self, passage: np.ndarray, term: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For (passage, term) pairs in order of passages: starts and ends of the passages' pairs, and (number of passage, block) of what may hold an item that reaches the threshold."""
        begin = _runs(passage)
        end = np.append(begin[1:], len(passage))
        group = np.repeat(np.arange(len(begin)), end - begin)
        order = np.lexsort((self.top[term], group))
        sums = np.cumsum(self.top[term[order]].astype(np.float64))
        sums -= np.repeat(np.concatenate(([0], sums))[begin], end - begin)
        essential = order[sums >= RETRIEVE - EPS]
        alive = np.unique(group[essential])  # the others have no pivot
        if not len(alive):
            return begin, end, alive, alive
        if self.matrix is not None:
            found = []
            for c in range(0, len(alive), 512):
                g = alive[c : c + 512]
                n = end[g] - begin[g]
                bound = np.add.reduceat(self.matrix[term[_spread(begin[g], n)]], np.cumsum(n) - n, axis=0)
                i, block = np.nonzero(bound >= RETRIEVE - EPS)
                found.append((g[i], block))
            return begin, end, *(np.concatenate(x) for x in zip(*found, strict=True))
        t = term[essential]
        n = self.at[t + 1] - self.at[t]
        looked = np.unique(np.repeat(group[essential], n) * self.blocks + self.key[_spread(self.at[t], n)] % self.blocks)
        found = [np.zeros(0, np.int64)]
        for c in range(0, len(looked), 4096):
            g, block = looked[c : c + 4096] // self.blocks, looked[c : c + 4096] % self.blocks
            n = end[g] - begin[g]
            k = self.held(term[_spread(begin[g], n)], np.repeat(block, n))
            bound = np.add.reduceat(np.where(k >= 0, self.most[k], 0), np.cumsum(n) - n)
            found.append(looked[c : c + 4096][bound >= RETRIEVE - EPS])
        held = np.concatenate(found)
        return begin, end, held // self.blocks, held % self.blocks

    def leaks(self, words: np.ndarray, of: np.ndarray) -> list[tuple[int, int, int, float, float, float, float]]:
        """(document of the slice, item, first word, score, containment, question, answer) of verified leaks."""
        span, stride = 3 * self.longest, self.longest
        where, term = self.vocabulary.find(words)
        if not len(where):
            return []
        doc = np.searchsorted(of, where, "right") - 1
        # a word lies in up to three passages, which start at multiples of the stride
        nth = np.minimum((where - of[doc]) // stride, np.maximum(0, (of[doc + 1] - of[doc] - 1) // stride))
        base = np.concatenate(([0], np.cumsum((np.maximum(np.diff(of), 1) - 1) // stride + 1)))
        in_each = [(base[doc] + nth - back)[nth >= back] for back in range(3)]
        passage, term = np.concatenate(in_each), np.concatenate([term[nth >= back] for back in range(3)])
        pair = np.unique(passage * len(self.vocabulary.hashes) + term)
        passage, term = pair // len(self.vocabulary.hashes), pair % len(self.vocabulary.hashes)
        begin, end, groups, blocks = self.open_blocks(passage, term)
        found: dict[tuple[int, int], tuple] = {}
        for g, j, _ in self.retrieved(begin, end, groups, blocks, term):
            p = int(passage[begin[g]])
            d = int(np.searchsorted(base, p, "right") - 1)
            own, first = words[of[d] : of[d + 1]], int((p - base[d]) * stride)
            for x in self.verified(j, own, first, first + stride):
                if x[1] > found.get((d, j), (0, 0.0))[1]:
                    found[d, j] = x
        return [(d, self.ids[j], f, s, c, q, a) for (d, j), (f, c, s, q, a) in found.items()]

    def verified(self, j: int, words: np.ndarray, first: int, last: int) -> Iterator[tuple[int, float, float, float, float]]:
        """(first word, containment, score, question, answer) of windows that leak item j, of those that start in [first, last).

        A window is twice the item's own length and starts at a multiple of it, whatever other items there are.
        """
        item, cut = self.flat[self.of[j] : self.of[j + 1]], self.answers[j]
        m = len(item)
        if not m:
            return
        if j not in self._grams:
            self._grams[j] = grams(item)
        need = self._grams[j]
        start = np.arange(-(-first // m) * m, min(last, max(len(words), 1)), m)
        if not len(start):
            return
        # each shingle that a window holds begins at a word of the item
        hits = np.concatenate(([0], np.cumsum(np.isin(words[start[0] : start[-1] + 2 * m], item))))
        stop = np.minimum(start + 2 * m, len(words))
        enough = hits[stop - start[0]] - hits[start - start[0]] >= CONTAIN * len(need)
        posts = self.by_item[self.item_at[j] : self.item_at[j + 1]]
        terms, impact = self.vocabulary.hashes[self.term[posts]], self.impact[posts].astype(np.float64)
        parts = [np.unique(item[:cut]), np.unique(item[cut:])]
        for s, e in zip(start[enough].tolist(), stop[enough].tolist(), strict=True):
            window = words[s:e]
            score = float(impact[np.isin(terms, window)].sum())
            held = float(np.isin(need, grams(window, min(WORDS, m))).mean())
            q, a = (float(np.isin(x, window).mean()) if len(x) else 1.0 for x in parts)
            if score >= RETRIEVE and held >= CONTAIN and q >= PART and a >= PART:
                yield s, held, score, q, a


def grams(words: np.ndarray, size: int = WORDS) -> np.ndarray:
    """Distinct shingles of `size` words; fewer words are one shingle."""
    if not len(words):
        return np.zeros(0, np.uint64)
    n = min(size, len(words))
    p = np.arange(len(words) - n + 1)
    return np.unique(tc.span(tc.prefix(words), p, p + n))


OUT = "doc_id long, item_id long, first_word long, score double, containment double, question_overlap double, answer_overlap double"


def _leak_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        names = [x.split()[0] for x in OUT.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), *[pa.float64()] * 4]
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for first, _, raw, at in tc.slices(lowered(batch.column(1))):
                start, end, of = term_bounds(raw, at)
                rows += [(ids[first + d], *x[:2], *(round(v, 6) for v in x[2:])) for d, *x in index.leaks(tc.word_hashes(raw, start, end), of)]
            if rows:
                yield _batch(rows, names, kinds)

    return run


def _length_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([len(w) for w, _ in _item_words(batch.column(0).to_pylist())], pa.int64())], ["words"])


def _term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(int(s), np.unique(w).astype(np.int64)) for s, (w, _) in zip(batch.column(0).to_pylist(), _item_words(batch.column(1).to_pylist()), strict=True)]
        shard = np.repeat(np.array([s for s, _ in rows], np.int32), [len(w) for _, w in rows])
        yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(np.concatenate([w for _, w in rows] or [np.zeros(0, np.int64)]))], ["shard", "term"])


def indexes(items: DataFrame) -> Iterator[ItemIndex]:
    """Indexes of items(i, t), one at a time; each holds about SHARD_BYTES of them, with statistics of all."""
    total = items.agg(F.coalesce(F.sum(F.octet_length("t")), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD_BYTES))
    if shards == 1:
        yield ItemIndex(sorted((r["i"], r["t"]) for r in items.collect()))
        return
    numbered = items.withColumn("shard", F.pmod(F.xxhash64("i", "t"), F.lit(shards)).cast("int"))
    n, mean, longest = numbered.select("t").mapInArrow(_length_rows, "words long").agg(F.count("*"), F.avg("words"), F.max("words")).first()
    terms = numbered.select("shard", "t").mapInArrow(_term_rows, "shard int, term long")
    df = terms.groupBy("term").agg(F.count("*").alias("n"))
    for s in range(shards):
        part = sorted((r["i"], r["t"]) for r in numbered.where(F.col("shard") == s).select("i", "t").collect())
        own = df.join(terms.where(F.col("shard") == s).select("term").distinct(), "term", "left_semi").toArrow()
        yield ItemIndex(part, n, mean, longest, {"term": own["term"].to_numpy().astype(np.int64).astype(np.uint64), "n": own["n"].to_numpy()})


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each row of docs and item that it leaks, with the best window's first term and figures.

    Null or empty texts and items, and items of null id, leak nothing; repeated rows give repeated rows. Items of
    fewer than five words must be held whole, in order. No items or no documents: no rows. Other columns are not looked at.
    """
    spark = docs.sparkSession
    tune(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    listed = items.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).distinct()
    out = None
    for index in indexes(listed):
        # some 20 bytes for each posting and word of at most about SHARD_BYTES of items
        found = own.mapInArrow(_leak_rows(spark.sparkContext.broadcast(index)), OUT)
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those that leak an item; a null id stays, as it cannot be named. All columns of docs stay as they are."""
    leak = fresh(docs, "leak")
    bad = find_leaks(docs, items, id_col, text_col).where("doc_id is not null").select(F.col("doc_id").alias(leak)).distinct()
    return docs.join(bad, F.col(id_col) == F.col(leak), "left_anti")
