import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tesselode.llm import decontaminate
from tesselode.llm import textcore as tc
from tesselode.llm.decontaminate import CONTAIN, PART, RETRIEVE, ItemIndex, drop_leaks, find_leaks
from tesselode.llm.terms import lowered, term_bounds

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def shingles(t):
    w = WORD.findall(t.lower())
    n = min(5, len(w))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()


def test_finds_what_brute_force_finds(spark):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    got = {(r["doc_id"], r["item_id"]): r for r in find_leaks(docs, items).collect()}
    want, bench = set(), [(i["item_id"], shingles(i["text"])) for i in items.collect()]
    for r in docs.collect():
        s = shingles(r["text"])
        want |= {(r["doc_id"], i) for i, g in bench if g and len(g & s) / len(g) >= CONTAIN}
    assert want and set(got) == want
    left = {r["doc_id"] for r in drop_leaks(docs, items).collect()}
    assert left == {r["doc_id"] for r in docs.select("doc_id").collect()} - {i for i, _ in want}


def test_edges(spark):
    text = " ".join(f"term{i}" for i in range(40)) + ". The answer is number forty two indeed."
    items = spark.createDataFrame([(1, text), (1, text), (2, None), (None, text), (3, ""), (4, "Short one.")], "item_id long, text string")
    pad = " ".join(f"pad{i}" for i in range(500))
    rows = [(1, f"{pad} {text.upper()} {pad}", 1), (2, f"{pad} {text.replace('term7 ', 'other ')} {pad}", 1), (3, pad, 1), (4, None, 1), (5, "", 1), (6, text[:100] + pad, 1), (7, f"{pad} short, one {pad}", 1), (1, f"{pad} {text}", 1), (8, "one short", 1), (None, text, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id int")
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in find_leaks(docs, items).collect())
    assert got == [("1", 1), ("1", 1), ("2", 1), ("7", 4), ("None", 1)]
    assert sorted(str(r["doc_id"]) for r in drop_leaks(docs, items).collect()) == ["3", "4", "5", "6", "8", "None"]
    assert find_leaks(docs, items.where("false")).count() == 0 and find_leaks(docs.where("false"), items).count() == 0


def random_items(r, n, words):
    return [(i, " ".join(r.choice(words) for _ in range(r.randint(3, 30))) + ". " + " ".join(r.choice(words) for _ in range(r.randint(1, 6)))) for i in range(n)]


@pytest.mark.parametrize("matrix", [0, 1 << 21])
def test_retrieval_and_rule_equal_brute_force(monkeypatch, matrix):
    """Every passage against every item, BM25 and question and answer counted plainly."""
    monkeypatch.setattr(decontaminate, "MATRIX", matrix)
    r = random.Random(11)
    words = ["w%d" % i for i in range(300)]
    items = random_items(r, 100, words)
    index = ItemIndex(items)
    assert (index.matrix is None) == (matrix == 0)
    texts = []
    for _ in range(60):
        t = [r.choice(words) for _ in range(r.randint(0, 200))]
        for _ in range(r.randint(0, 3)):
            w = r.choice(items)[1].replace(".", "").split()
            w = [x if r.random() > 0.04 else "other" for x in w[: r.randint(1, len(w)) if r.random() < 0.5 else len(w)]]
            p = r.randint(0, len(t))
            t[p:p] = w
        texts.append(" ".join(t))
    bags = [(i, t.replace(".", "").split(), len(t.split(". ")[0].split())) for i, t in items]
    mean, n = sum(len(w) for _, w, _ in bags) / len(bags), len(bags)
    df = {w: sum(w in set(b) for _, b, _ in bags) for w in words}

    def impact(w, bag):
        tf = bag.count(w)
        return np.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(bag) / mean))

    grams = lambda x, k: {tuple(x[p : p + k]) for p in range(len(x) - k + 1)}
    want = set()
    for d, t in enumerate(texts):
        t = t.split()
        for i, bag, cut in bags:
            for p in range(0, max(len(t), 1), len(bag)):
                passage = t[p : p + 2 * len(bag)]
                held = set(passage)
                score = sum(impact(w, bag) for w in set(bag) & held) / sum(impact(w, bag) for w in set(bag))
                g = grams(bag, min(5, len(bag)))
                q, a = (sum(w in held for w in set(x)) / len(set(x)) for x in (bag[:cut], bag[cut:]))
                if score >= RETRIEVE and len(g & grams(passage, min(5, len(bag)))) >= CONTAIN * len(g) and q >= PART and a >= PART:
                    want.add((d, i))
    got = set()
    for first, _, raw, at in tc.slices(lowered(pa.array(texts))):
        start, end, of = term_bounds(raw, at)
        got |= {(first + d, i) for d, i, *_ in index.leaks(tc.word_hashes(raw, start, end), of)}
    assert len(want) > 20 and got == want


def test_other_items_change_no_leak(spark):
    """Words of an item that lie far apart are no leak, whatever the length of another item; those side by side are one."""
    item = "which river flows through the old town here. the green one"
    far = [f"pad{i}" for i in range(1500)]
    apart, near = far[:600] + item.split()[:6] + far[600:1100] + item.split()[6:] + far[1100:], far[:611] + item.split() + far[611:]
    docs = spark.createDataFrame([(1, " ".join(apart)), (2, " ".join(near)), (3, " ".join(far))], "doc_id long, text string")
    for others in ([], [(9, " ".join(f"long{i}" for i in range(1000)))], [(9, " ".join(f"q{i}" for i in range(17))), (8, "pad3 one")]):
        got = find_leaks(docs, spark.createDataFrame([(1, item), *others], "item_id long, text string")).where("item_id = 1").collect()
        assert [r["doc_id"] for r in got] == [2], others


def test_any_shard_size_gives_the_same_rows(spark, monkeypatch):
    d = "/root/testdata/sf0.01"
    docs, items = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = sorted(map(tuple, find_leaks(docs, items).collect()))
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 2000)
    assert whole and sorted(map(tuple, find_leaks(docs, items).collect())) == whole


def test_an_index_of_many_items_is_small():
    r = random.Random(2)
    words = ["t%d" % int(60_000 * r.random() ** 3) for _ in range(100_000)]
    index = ItemIndex([(i, " ".join(r.choices(words, k=60))) for i in range(5000)])
    size = sum(x.nbytes for x in vars(index).values() if isinstance(x, np.ndarray)) + sum(x.nbytes for x in vars(index.vocabulary).values() if isinstance(x, np.ndarray))
    assert size < 40 * len(index.flat) + (8 << 20)


def test_clashing_names(spark):
    text = " ".join(f"term{i}" for i in range(40))
    docs = spark.createDataFrame([(1, text, 5, "x", 2), (2, "calm sea", None, None, 3)], "doc_id long, text string, item_id int, score string, __leak long")
    left = drop_leaks(docs, spark.createDataFrame([(1, text, 0)], "item_id long, text string, doc_id long"))
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(2, "calm sea", None, None, 3)]
