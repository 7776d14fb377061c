import zlib

import numpy as np
import pyarrow as pa
import pytest

from tesselode.llm import textcore as tc
from tesselode.llm.queries import op4_toxicity
from tesselode.llm.terms import Vocabulary, lowered
from tesselode.llm.toxicity import fit, score, vectors


@pytest.fixture(scope="module")
def scored(spark):
    d = "/root/testdata/sf0.1"
    return {r["doc_id"]: r for r in op4_toxicity(spark, d).collect()}, {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}


def test_held_out_accuracy(scored):
    rows, labels = scored
    assert len(rows) == 10_000
    held = [(r["predicted"], labels[i], r["score"]) for i, r in rows.items() if r["held_out"] and i in labels]
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    tp = sum(p and t for p, t, _ in held)
    precision, recall = tp / max(1, sum(p for p, _, _ in held)), tp / sum(t for _, t, _ in held)
    print(len(held), precision, recall)
    assert precision > 0.9 and recall > 0.9
    # calibrated: where scores are high the labels are toxic, where they are low they are not
    assert np.mean([t for _, t, s in held if s < 0.1]) < 0.03 and np.mean([t for _, t, s in held if s > 0.8]) > 0.85


def test_search_is_exact(spark, sf):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    m = fit(docs, labels)
    r = np.random.default_rng(0)
    assert m.matrix.shape[1] > 20
    for _ in range(200):
        term = np.sort(r.choice(len(m.terms), min(5, len(m.terms)), replace=False))
        w = r.random(len(term)).astype(np.float32)
        w /= np.linalg.norm(w)
        ids, cos = m.nearest(term, w)
        brute = w @ m.matrix[term]
        want = np.sort(brute[brute > 0])[::-1][: len(ids)]
        assert np.allclose(cos, want, atol=1e-5) and len(ids) == min(15, int((brute > 0).sum()))


def test_nulls_empty_and_no_labels(spark):
    rows = [(i, "you idiot moron scum" if i % 2 else "the calm sea", i % 2) for i in range(40)] + [(90, None, None), (91, "", 0), (None, "you idiot", 1), (3, "you idiot", 1)]
    docs = spark.createDataFrame([(i, t, "s") for i, t, _ in rows], "doc_id long, text string, score_of string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = score(docs, fit(docs, labels)).collect()
    assert len(got) == len(rows)
    assert all((r["score"] > 0.5) == bool(r["text"] and "idiot" in r["text"]) for r in got)
    none = fit(docs, labels.where("false"))
    assert {r["score"] for r in score(docs, none).collect()} == {0.5}
    assert score(docs.where("false"), fit(docs.where("false"), labels)).count() == 0


def test_clashing_columns_and_evidence(spark):
    rows = [(i, ("you idiot moron scum" if i % 2 else "the calm sea") + f" w{i}", "old", 3) for i in range(40)] + [(99, None, "old", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string, evidence int")
    labels = spark.createDataFrame([(i, i % 2) for i in range(30)], "doc_id long, toxic int")
    m = fit(docs, labels)
    plain = score(docs, m)
    assert plain.columns == ["doc_id", "text", "evidence", "score"] and {r["evidence"] for r in plain.collect()} == {3, 4}
    got = {r["doc_id"]: r for r in score(docs, m, evidence=2).collect()}
    assert got[99]["evidence"] == [] and got[99]["text"] is None
    for i in range(30):  # a labelled text is its own nearest example
        e = got[i]["evidence"]
        assert len(e) == 2 and (e[0]["doc_id"], e[0]["cosine"], e[0]["toxic"]) == (i, 1.0, i % 2) and e[1]["toxic"] == i % 2
    assert {r["doc_id"]: r["score"] for r in plain.collect()} == {i: r["score"] for i, r in got.items()}


def test_votes_equal_brute_force(spark):
    """The score of every text, from dense cosines to every example."""
    r = np.random.default_rng(8)
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper"]
    texts = [" ".join(r.choice(words, r.integers(1, 12))) for _ in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    m = fit(docs, spark.createDataFrame([(i, int(r.random() < 0.3)) for i in range(100)], "doc_id long, toxic int"))
    whole = m.matrix[np.arange(len(m.terms))].astype(float)
    for row in score(docs, m).collect():
        v = vectors(*next(tc.slices(lowered(pa.array([row["text"]]))))[2:], Vocabulary(m.terms), m.idf)
        cos = np.round(sum(w * whole[t] for t, w in zip(v.term, v.weight, strict=True)), 6)
        near = sorted((-c, e) for e, c in enumerate(cos) if c > 0)[:15]
        votes = [(np.sqrt(m.count[e]) / (1 + c + 0.05), m.toxic[e] / m.count[e]) for c, e in near]
        want = (sum(a * b for a, b in votes) + 2 * m.rate) / (sum(a for a, _ in votes) + 2)
        assert abs(row["score"] - want) < 1e-3


def test_copies_without_marking_terms_are_found(spark):
    word = lambda i, j: f"q{chr(97 + i // 26)}{chr(97 + i % 26)}{chr(97 + j)}"
    texts = [" ".join(word(i, j) for j in range(8)) for i in range(60)]  # no two share a term
    docs = spark.createDataFrame([(i, texts[i % 60]) for i in range(120)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i in range(60)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in score(docs, fit(docs, labels)).collect()}
    assert all((got[i] > 0.5) == (i % 6 == 0) for i in range(120)), got


def test_nearest_equals_brute_force_over_all_terms(spark):
    r = np.random.default_rng(3)
    # of distinct beginnings, so that a word's terms are itself and its beginnings alone
    words = ["alder", "birch", "cedar", "dogwood", "elm", "fir", "ginkgo", "hazel", "ivy", "juniper", "kapok", "larch"]
    texts = [" ".join(r.choice(words, r.integers(1, 9))) for _ in range(200)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int("elm" in texts[i])) for i in range(150)], "doc_id long, toxic int")
    m = fit(docs, labels)
    cut = lambda t: [w[:n] for w in t.split() for n in (4, 7, 99) if n == 99 or len(w) > n]
    df = {w: sum(w in cut(t) for t in texts) for t in texts for w in cut(t)}
    known = {w for t in texts[:150] for w in cut(t)}
    marks = {"elm"}

    def vector(t):
        own = [w for w in cut(t) if w in known]
        v = {w: (1 + np.log(own.count(w))) * (np.log(201 / (1 + df[w])) + 1) * (4 if w in marks else 1) for w in set(own)}
        norm = np.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    examples = {tuple(sorted(vector(t).items())) for t in texts[:150]}
    assert m.matrix.shape == (len(known), len(examples))
    for t in texts[150:]:
        q = vector(t)
        want = sorted((sum(q.get(w, 0) * x for w, x in e) for e in examples), reverse=True)
        v = vectors(*next(tc.slices(lowered(pa.array([t]))))[2:], Vocabulary(m.terms), m.idf)
        assert np.allclose(m.nearest(v.term, v.weight)[1], [x for x in want if x > 0][:15], atol=1e-5)
