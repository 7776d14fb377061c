import random

import numpy as np

from tesselode.llm.components import components
from tesselode.llm.minhash_dedup import REGISTERS, drop_near_duplicates, near_duplicates, plausible, sketch

SCHEMA = "doc_id long, text string"


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    where = {}
    for k, (_, s) in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(k)
    for p, q in {(p, q) for m in where.values() for x, p in enumerate(m) for q in m[x + 1 :]}:
        (i, a), (j, b) = sets[p], sets[q]
        if 100 * len(a & b) >= 75 * len(a | b):
            x, y = sorted((root(i), root(j)))
            parent[y] = x
    return {i: (len(s), root(i), root(i) == i) for i, s in sets}


def crowd():
    r = random.Random(3)
    words = ["w%d" % i for i in range(500)]
    rows, i = [], 10
    for size, length, most in ((90, 120, 9), (40, 60, 5), (30, 400, 40), (2, 80, 1)):
        base = [r.choice(words) for _ in range(length)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, most)):
                t[r.randrange(len(t))] = r.choice(words)
            rows.append((i, " ".join(t)))
            i += 3
    rows += [(5000, None), (5001, ""), (5002, " \n"), (5003, "One Two"), (5004, "one two"), (5005, "one two three"), (5006, "ONE two"), (4, rows[0][1]), (None, rows[0][1]), (12, rows[-1][1] + " x"), (12, rows[-1][1] + " x")]
    r.shuffle(rows)
    return rows


def test_equals_brute_force_in_crowded_buckets(spark):
    rows = crowd()
    got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    want = brute(rows)
    assert len(got) == len(rows)
    assert {g["doc_id"]: tuple(g[1:]) for g in got if g["doc_id"] is not None} == want
    assert [tuple(g)[2:] for g in got if g["doc_id"] is None] == [(None, True)]


def test_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {g["doc_id"]: tuple(g[1:]) for g in near_duplicates(docs).collect()}
    assert got == want and any(not v[2] for v in got.values())
    assert {r["doc_id"] for r in drop_near_duplicates(docs).collect()} == {i for i, v in want.items() if v[2]}


def test_likelihood_keeps_similar_sets():
    r = np.random.default_rng(1)
    missed = kept_far = 0
    for _ in range(200):
        common = r.integers(0, 1 << 63, 300, dtype=np.uint64)
        a, b = (np.concatenate((common, r.integers(0, 1 << 63, 50, dtype=np.uint64))) for _ in range(2))
        c = np.concatenate((common[:100], r.integers(0, 1 << 63, 250, dtype=np.uint64)))
        x, y, z = sketch(a), sketch(b), sketch(c)
        count = lambda p, q: (np.array([(p > q).sum()]), np.array([(p < q).sum()]))
        missed += not plausible([350], [350], *count(x, y))[0]
        kept_far += plausible([350], [350], *count(x, z))[0]
    assert missed == 0 and kept_far < 5 and REGISTERS == 128


def test_components_of_long_paths(spark):
    links = [(i, i + 1) for i in range(70)] + [(200, 300), (300, 100), (500, 500)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 71)} | {200: 100, 300: 100}


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = (" ".join(f"{k}{i}" for i in range(30)) for k in "abc")
    rows = [(3, a), (5, a), (5, b), (7, b), (5, ""), (9, c), (9, c), (9, ""), (9, "")]
    docs = spark.createDataFrame([(*r, 1, "x", r[0]) for r in rows], SCHEMA + ", n int, component_id string, tx long")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(docs).collect())
    assert got == [(3, 26, 3, True), (5, 0, 5, True), (5, 26, 3, False), (5, 26, 3, False), (7, 26, 3, False), (9, 0, 9, True), (9, 0, 9, True), (9, 26, 9, True), (9, 26, 9, True)]
    left = drop_near_duplicates(docs)
    assert left.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in left.collect()) == [(3, a), (5, ""), (9, ""), (9, c)]
    # of several texts of the smallest id the one with the most shingles stays
    pair = spark.createDataFrame([(1, a), (1, a + " " + b), (2, a)], SCHEMA)
    assert [r["text"] for r in drop_near_duplicates(pair).collect()] == [a + " " + b]


def test_a_hub_is_split(spark, monkeypatch):
    from tesselode.llm import runtime

    monkeypatch.setattr(runtime, "HOT", 3)
    links = [(7, i) for i in range(100, 400)] + [(i, 399) for i in range(500, 800)] + [(3, 600), (900, 901)]
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 3 for i in [7, *range(100, 400), *range(500, 800)]} | {901: 900}


def test_recall_of_the_law_on_a_larger_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    got = {g["doc_id"]: tuple(g[1:]) for g in near_duplicates(docs).collect()}
    grouped = [i for i, v in want.items() if v[1] != i]
    assert len(grouped) > 50 and sum(got[i] == want[i] for i in grouped) >= 0.999 * len(grouped)
    assert all(got[i][0] == v[0] for i, v in want.items())


def test_empty(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_only_members_with_partners_left_visit_again(spark, monkeypatch):
    from tesselode.llm import minhash_dedup as M

    seen, own = [], M._proposed

    def counted(members, visits, sets, comps, best):
        seen.append((members.count(), visits.count()))
        return own(members, visits, sets, comps, best)

    rows = crowd()
    monkeypatch.setattr(M, "_proposed", counted)
    for best, again in ((1000, False), (1, True)):
        monkeypatch.setattr(M, "BEST", best)
        got = near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
        assert {g["doc_id"]: tuple(g[1:]) for g in got if g["doc_id"] is not None} == brute(rows)
        first, second = seen[-2:]
        assert second[1] < first[1] and (second != (0, 0)) == again
