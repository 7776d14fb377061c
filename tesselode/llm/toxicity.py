"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over an inverted index of all their terms.

Terms are words and their beginnings of 4 and 7 bytes. A bounded sample of labelled documents gives the
vocabulary, all of its terms, and the examples; document frequencies are counted over all documents. Terms that mark
toxic examples, by the lower bound of their precision, weigh MARK times as much; no term is left out.
Examples with equal vectors are one, with its count of labels. A search adds up the cosine to every example, common
terms by a dense product and the others by their postings, so the nearest are exact. They vote with weights
1 / (distance + 0.05); the base rate joins the vote, which keeps scores calibrated where evidence is thin. The nearest
are the evidence of a score. Block bounds are not kept: texts of hundreds of terms leave few blocks out (see README).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textcore as tc
from .repeats import _batch
from .runtime import materialise, tune
from .terms import Vocabulary, lowered, term_bounds

PREFIXES = (4, 7)
#: Labelled documents that are fitted on, neighbours, weight of the base rate.
FIT_ROWS, NEIGHBOURS, PRIOR = 16384, 15, 2.0
#: To weigh MARK times as much a term needs this many toxic examples, and a lower bound of its precision this many times the base rate; Z is high, as very many terms are tried.
LEAST_TOXIC, LIFT, Z, MARK = 4, 3.0, 3.3, 4.0
#: Terms in one of COMMON examples have a dense row, at most DENSE of them; documents a dense product takes.
COMMON, DENSE, TOGETHER = 18, 1024, 512
#: Terms whose document frequencies travel together.
CHUNK = 1 << 14
THRESHOLD = 0.3


def features(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the terms of a slice: words and their beginnings."""
    start, end, of = term_bounds(raw, at)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    sums = tc.prefix(tc.BYTE_VALUES[raw])
    doc = np.repeat(np.arange(len(at) - 1), np.diff(of))
    docs, terms = [doc], [tc.span(sums, start, end)]
    for n in PREFIXES:
        long = np.flatnonzero(end - start > n)
        docs.append(doc[long])
        terms.append(tc.span(sums, start[long], start[long] + n))
    return np.concatenate(docs), np.concatenate(terms)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text, toxic): per term the documents that hold it, and the toxic ones."""
    h, n, t = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for first, last, raw, at in tc.slices(lowered(batch.column(0))):
            doc, term = features(raw, at)
            if not len(term):
                continue
            own, k = np.unique(term, return_inverse=True)
            pair = np.unique(doc * len(own) + k)
            doc, k = pair // len(own), pair % len(own)
            some, hits = np.bincount(k, minlength=len(own)), np.bincount(k[toxic[first:last][doc] > 0], minlength=len(own))
            h, back = np.unique(np.concatenate((h, own)), return_inverse=True)
            n = np.bincount(back, np.concatenate((n, some)), len(h)).astype(np.int64)
            t = np.bincount(back, np.concatenate((t, hits)), len(h)).astype(np.int64)
    for i in range(0, len(h), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 50_000].astype(np.int64)), pa.array(n[i : i + 50_000]), pa.array(t[i : i + 50_000])], ["term", "n", "t"])


def _vocabulary_of(sample: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Terms of sample(text, toxic) in order, the documents that hold them, and the toxic ones."""
    sums = sample.mapInArrow(_counts, "term long, n long, t long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("t").alias("t")).toArrow()
    term, n, t = (sums.column(c).to_numpy() for c in ("term", "n", "t"))
    term = term.astype(np.int64).astype(np.uint64)
    order = np.argsort(term)
    return term[order], n[order], t[order]


def _known_counts(shared):
    """Task over (text): for every CHUNK of the broadcast terms, how many documents hold each, as a blob."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        size = len(vocabulary.hashes)
        n = np.zeros(size, "<i4")
        for batch in batches:
            for _, _, raw, at in tc.slices(lowered(batch.column(0))):
                doc, term = features(raw, at)
                i, k = vocabulary.find(term)
                n += np.bincount(np.unique(doc[i] * size + k) % size, minlength=size).astype("<i4")
        yield _batch([(c // CHUNK, n[c : c + CHUNK].tobytes()) for c in range(0, size, CHUNK) if n[c : c + CHUNK].any()], ["chunk", "n"], [pa.int32(), pa.binary()])

    return run


def _sum_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for batch in batches:
        for c, blob in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            x = np.frombuffer(blob, "<i4").astype(np.int64)
            sums[c] = sums[c] + x if c in sums else x
    yield _batch([(c, x.astype("<i8").tobytes()) for c, x in sums.items()], ["chunk", "n"], [pa.int32(), pa.binary()])


def _frequencies(texts: DataFrame, terms: np.ndarray) -> np.ndarray:
    """How many of texts hold each term."""
    out = np.zeros(len(terms), np.int64)
    if len(terms):
        shared = texts.sparkSession.sparkContext.broadcast(terms)
        chunks = texts.mapInArrow(_known_counts(shared), "chunk int, n binary").repartition("chunk").mapInArrow(_sum_chunks, "chunk int, n binary")
        for r in chunks.toLocalIterator():
            x = np.frombuffer(r["n"], "<i8")
            out[r["chunk"] * CHUNK : r["chunk"] * CHUNK + len(x)] = x
    return out


@dataclass
class Vectors:
    """Rows of unit TF-IDF vectors of a slice: document, term number and weight, sorted by document."""

    doc: np.ndarray
    term: np.ndarray
    weight: np.ndarray


def counted(raw: np.ndarray, at: np.ndarray, vocabulary: Vocabulary) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term number, count) of a slice, sorted by document, then by term."""
    doc, term = features(raw, at)
    i, k = vocabulary.find(term)
    size = max(1, len(vocabulary.hashes))
    pair, tf = np.unique(doc[i] * size + k, return_counts=True)
    return pair // size, pair % size, tf


def vectors(raw: np.ndarray, at: np.ndarray, vocabulary: Vocabulary, idf: np.ndarray) -> Vectors:
    doc, k, tf = counted(raw, at, vocabulary)
    w = (1 + np.log(tf)) * idf[k] if len(k) else np.zeros(0)
    norm = np.sqrt(np.bincount(doc, w * w, len(at) - 1)) if len(k) else np.ones(len(at) - 1)
    return Vectors(doc, k, w / norm[doc] if len(k) else w)


@dataclass
class Matrix:
    """Weights[term, example] as postings: those of term t are at[t] to at[t + 1]."""

    shape: tuple[int, int]
    at: np.ndarray
    example: np.ndarray
    weight: np.ndarray

    def __getitem__(self, terms: np.ndarray) -> np.ndarray:
        """Dense rows."""
        out = np.zeros((len(terms), self.shape[1]), np.float32)
        for row, t in zip(out, terms, strict=True):
            row[self.example[self.at[t] : self.at[t + 1]]] = self.weight[self.at[t] : self.at[t + 1]]
        return out

    def dot(self, terms: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The sum of these rows, times their weights."""
        n = self.at[terms + 1] - self.at[terms]
        i = np.repeat(self.at[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return np.bincount(self.example[i], self.weight[i] * np.repeat(weight, n), self.shape[1])


@dataclass
class Model:
    """The fitted index. terms: hashes; idf by term number, times MARK where a term marks toxic examples; postings as
    example and count of the term there, those of term t from at[t] on; each example's labels, toxic ones, and least id."""

    terms: np.ndarray
    idf: np.ndarray
    at: np.ndarray
    example: np.ndarray
    tf: np.ndarray
    count: np.ndarray
    toxic: np.ndarray
    ids: np.ndarray
    rate: float
    blank: float

    @cached_property
    def matrix(self) -> Matrix:
        # some terms at a time, as a worker's memory is small
        weight, squares = np.empty(len(self.example), np.float32), np.zeros(len(self.count))
        scale = 1 + np.log(np.arange(1, int(self.tf.max(initial=1)) + 1))
        cuts = [*range(0, len(self.terms), CHUNK), len(self.terms)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            own = slice(self.at[lo], self.at[hi])
            x = scale[self.tf[own].astype(np.int64) - 1] * np.repeat(self.idf[lo:hi], np.diff(self.at[lo : hi + 1]))
            squares += np.bincount(self.example[own], x * x, len(self.count))
            weight[own] = x
        norm = np.sqrt(squares).astype(np.float32)
        for lo in range(0, len(weight), 1 << 20):
            weight[lo : lo + (1 << 20)] /= norm[self.example[lo : lo + (1 << 20)]]
        return Matrix((len(self.terms), len(self.count)), self.at, self.example.astype(np.int32), weight)

    @cached_property
    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """The row of each common term, -1 for others, and the rows."""
        n = np.diff(self.at)
        common = np.flatnonzero(n * COMMON >= len(self.count)) if len(self.count) else np.zeros(0, np.int64)
        common = common[np.argsort(-n[common], kind="stable")[:DENSE]]
        row = np.full(len(n), -1, np.int32)
        row[common] = np.arange(len(common))
        return row, self.matrix[common]

    def cosines(self, v: Vectors, docs: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        """(document, cosine to every example) for those of v."""
        row, rows = self.dense
        cut = np.searchsorted(v.doc, docs), np.searchsorted(v.doc, docs, "right")
        for c in range(0, len(docs), TOGETHER):
            lo, hi = cut[0][c : c + TOGETHER], cut[1][c : c + TOGETHER]
            own = np.concatenate([np.arange(i, j) for i, j in zip(lo, hi, strict=True)])
            own = own[row[v.term[own]] >= 0]
            query = np.zeros((len(lo), len(rows)), np.float32)
            query[np.searchsorted(docs, v.doc[own]) - c, row[v.term[own]]] = v.weight[own]
            for d, i, j, cos in zip(docs[c : c + TOGETHER], lo, hi, query @ rows, strict=True):
                rare = np.flatnonzero(row[v.term[i:j]] < 0) + i
                cos += self.matrix.dot(v.term[rare], v.weight[rare].astype(np.float32))
                yield int(d), cos

    def top(self, cos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest examples of all cosines; ties, to six digits, by number."""
        least = np.partition(cos, -NEIGHBOURS)[-NEIGHBOURS] - 2e-6 if len(cos) > NEIGHBOURS else 0
        ids = np.flatnonzero((cos > 0) & (cos >= least))
        ids = ids[np.lexsort((ids, -np.round(cos[ids], 6)))[:NEIGHBOURS]]
        return ids, cos[ids]

    def nearest(self, term: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The examples nearest to a unit vector, and their cosines; exact, ties by number."""
        v = Vectors(np.zeros(len(term), np.int64), np.asarray(term), np.asarray(weight))
        return self.top(next(self.cosines(v, np.zeros(1, np.int64)))[1])

    def vote(self, ids: np.ndarray, cos: np.ndarray) -> float:
        if not len(ids):
            return self.blank
        vote = 1 / (1 - np.minimum(cos, 1) + 0.05)
        share = (self.toxic[ids] + 0.0) / self.count[ids]
        # an example met often votes more, by the root of its count
        vote = vote * np.sqrt(self.count[ids])
        return float((np.sum(vote * share) + PRIOR * self.rate) / (np.sum(vote) + PRIOR))


def _example_rows(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shared.value)
        for batch in batches:
            toxic, ids = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for first, last, raw, at in tc.slices(lowered(batch.column(0))):
                doc, k, tf = counted(raw, at, vocabulary)
                cut = np.searchsorted(doc, np.arange(last - first + 1))
                yield _batch([(k[i:j].astype("<i4").tobytes(), tf[i:j].astype("<u4").tobytes(), int(toxic[first + d]), ids[first + d]) for d, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True))], ["term", "tf", "toxic", "id"], [pa.binary(), pa.binary(), pa.int64(), pa.int64()])

    return run


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS) -> Model:
    """A model from labels(doc_id, toxic) of docs; at most fit_rows labelled documents, chosen by a hash of the id.

    Null labels and ids are left out; of several labels of an id the largest counts. Without labels every score is
    the smoothed base rate.
    """
    tune(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marks = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("__l")).agg((F.max(label_col) > 0).cast("int").alias("toxic"))
    some = materialise(marks.orderBy(F.xxhash64("__l"), "__l").limit(fit_rows))
    sample = materialise(own.join(some, F.col("__id") == F.col("__l")).select("text", "toxic", F.col("__id").cast("long").alias("id")))
    rows, hits = sample.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    rate = (hits + 0.5) / (rows + 1)
    terms, n, t = _vocabulary_of(sample.select("text", "toxic"))
    p = t / np.maximum(n, 1)
    lower = (p + Z * Z / (2 * n) - Z * np.sqrt((p * (1 - p) + Z * Z / (4 * n)) / n)) / (1 + Z * Z / n)
    marking = (t >= LEAST_TOXIC) & (lower >= min(LIFT * rate, 0.6))
    # every term of the examples is a term of some document
    idf = (np.log((1 + own.count()) / (1 + _frequencies(own.select("text"), terms))) + 1) * np.where(marking, MARK, 1.0)
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    groups = sample.mapInArrow(_example_rows(shared), "term binary, tf binary, toxic long, id long").groupBy("term", "tf").agg(F.count("*").alias("n"), F.sum("toxic").alias("t"), F.min("id").alias("id"))
    # a partition at a time into plain buffers, as the driver is small; in the order of ids, so that numbers do not hang on the partitions
    term, tf, length, figures, blank = bytearray(), bytearray(), [], [], (0, 0)
    for r in groups.orderBy("id", F.xxhash64("term", "tf")).toLocalIterator():
        if r["term"]:
            term += r["term"]
            tf += r["tf"]
            length.append(len(r["term"]) // 4)
            figures.append((r["n"], r["t"], r["id"]))
        else:
            blank = (r["n"], r["t"])
    term, tf = np.frombuffer(term, "<i4"), np.frombuffer(tf, "<u4")
    count, toxic, ids = (np.array([x[k] for x in figures], kind) for k, kind in enumerate((float, float, np.int64)))
    at = np.concatenate(([0], np.cumsum(np.bincount(term, minlength=len(terms)))))
    # an example's postings go behind those of the examples before it
    free = at[:-1].copy()
    example = np.empty(len(term), np.min_scalar_type(len(figures)))
    often = np.empty(len(term), np.min_scalar_type(tf.max(initial=1)))
    begin = 0
    for e, n in enumerate(length):
        own = term[begin : begin + n]
        example[free[own]], often[free[own]] = e, tf[begin : begin + n]
        free[own] += 1
        begin += n
    del term, tf, free
    pa.default_memory_pool().release_unused()
    n0, t0 = blank
    return Model(terms, idf, at, example, often, count, toxic, ids, rate, (t0 + PRIOR * rate) / (n0 + PRIOR))


def _score_rows(model, text_col: str, evidence: int):
    kind = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        vocabulary = Vocabulary(m.terms)
        for batch in batches:
            scores, near = np.full(batch.num_rows, m.blank), [[] for _ in range(batch.num_rows)]
            for first, last, raw, at in tc.slices(lowered(batch.column(text_col)), 2 * tc.SLICE_BYTES):
                v = vectors(raw, at, vocabulary, m.idf)
                for d, cos in m.cosines(v, np.unique(v.doc)) if len(m.count) else ():
                    ids, c = m.top(cos)
                    scores[first + d] = m.vote(ids, c)
                    near[first + d] = [{"doc_id": int(m.ids[i]), "cosine": round(float(x), 6), "toxic": float(m.toxic[i] / m.count[i])} for i, x in zip(ids[:evidence], c[:evidence], strict=True)]
            columns, names = [*batch.columns, pa.array(np.clip(np.round(scores, 6), 0, 1))], [*batch.schema.names, "score"]
            if evidence:
                columns, names = [*columns, pa.array(near, kind)], [*names, "evidence"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def score(docs: DataFrame, model: Model, text_col: str = "text", evidence: int = 0) -> DataFrame:
    """docs with a score from 0 to 1 for every row and, if asked for, that many nearest examples as evidence.

    Evidence: the least document id of an example, its cosine, and the toxic share of its labels, nearest first, at most
    NEIGHBOURS. Texts without a term of the examples, as null and empty ones, get the score of examples without terms, and
    no evidence. Columns of docs named score or evidence are replaced; all others pass through. No rows: none.
    """
    tune(docs.sparkSession)
    docs = docs.drop("score", *["evidence"] * bool(evidence))
    # an id and a count for each distinct term of each example, at most FIT_ROWS of them
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = ["score double"] + ["evidence array<struct<doc_id: bigint, cosine: double, toxic: double>>"] * bool(evidence)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + added)
    return docs.mapInArrow(_score_rows(shared, text_col, evidence), schema)
