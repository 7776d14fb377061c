import hashlib
import random
import re

from tesselode.llm.order_minhash import edited_text, fingerprints, likeness, order_minhash

SCHEMA = "doc_id long, text string"


def test_whole_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(5)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), reverse=True)
    prints = fingerprints([t for _, t in rows])
    got = {r["doc_id"]: r for r in order_minhash(docs).collect()}
    assert len(got) == len(rows) == docs.count()
    better = 0
    for k, (i, t) in enumerate(rows):
        n = (k + 1) % len(rows)
        e = edited_text(t, rows[n][1])
        g, f = got[i], fingerprints([e])[0]
        assert (g["n_chars"], g["edited_sha256"]) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert (g["fingerprint"], g["edited_fingerprint"]) == (prints[k], f)
        assert (g["near_edited"], g["near_next"]) == (likeness(prints[k], f), likeness(prints[k], prints[n]))
        better += g["near_edited"] > g["near_next"] or t == rows[n][1]
    assert better > 0.9 * len(rows)


def test_order_and_edits_matter():
    r = random.Random(1)
    words = ["w%d" % i for i in range(200)]
    text = [r.choice(words) for _ in range(400)]
    moved = text[200:] + text[:200]
    few = [("x" if i % 100 == 50 else w) for i, w in enumerate(text)]
    a, b, c, d = fingerprints([" ".join(x) for x in (text, moved, few, [r.choice(words) for _ in range(400)])])
    assert likeness(a, a) == 1 and likeness(a, c) > 0.75 and likeness(a, b) < likeness(a, c) - 0.2 and likeness(a, d) < 0.1


def test_ties_nulls_repeats_small(spark):
    rows = [(3, "a b c"), (3, "a b d"), (3, "a b c"), (None, "n n n n"), (1, None), (9, ""), (2, "日本語 テキスト é " * 5)]
    got = order_minhash(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    assert {g["fingerprint"] for g in got if g["doc_id"] in (1, 9)} == {""}
    one = order_minhash(spark.createDataFrame([(1, "abcdef")], SCHEMA)).collect()
    assert len(one) == 1 and one[0]["edited_sha256"] == hashlib.sha256(b"abcdab").hexdigest()
    twin = order_minhash(spark.createDataFrame([(1, "abc"), (1, "abc")], SCHEMA)).collect()
    assert len(twin) == 2
    assert order_minhash(spark.createDataFrame([], SCHEMA)).count() == 0


def plain_fingerprint(text):
    """The tuples of the method, one function and one k-mer at a time, over whatever hash gives the order."""
    import numpy as np

    from tesselode.llm import order_minhash as o
    from tesselode.llm import textcore as tc

    raw = np.frombuffer(text.encode(), np.uint8)
    numbered = o.kmers(raw, np.array([0, len(raw)]))[0]
    words = [u for w in re.split("[ \t-\r]+", text) if w for u in ([w] if len(w.encode()) <= o.LONG else w)]
    grams = [tuple(words[i : i + o.K]) for i in range(len(words) - o.K + 1)] or ([tuple(words)] if words else [])
    seen, keys = {}, []
    for g in grams:
        seen[g] = seen.get(g, 0) + 1
        keys.append((g, seen[g]))
    # the same numbered k-mer has the same hash, others have others
    assert len(numbered) == len(keys) and len(set(zip(keys, numbered.tolist(), strict=True))) == len(set(keys)) == len(set(numbered.tolist()))
    out = []
    for m in range(o.M):
        high, low = [[int(x) >> s & 0xFFFFFFFF for x in numbered] for s in (32, 0)]
        h = [(int(o._MUL[m]) * a + int(o._MUL2[m]) * b + int(o._ADD[m])) & 0xFFFFFFFF for a, b in zip(high, low, strict=True)]
        least = sorted(range(len(h)), key=lambda i: (h[i], i))[: o.L]
        out.append(tuple(keys[i] for i in sorted(least)))
    return out


def test_fingerprints_equal_a_plain_version():
    r = random.Random(9)
    texts = [" ".join(r.choice(["a", "b", "c", "dd", "é"]) for _ in range(r.randint(0, 60))) for _ in range(40)]
    texts += [texts[0], "a b c " * 30, "one", "one two", "漢字" * 40, "x" * 32 + " " + "y" * 33 + " z", "é" * 17 + "ab", "漢字かな交じり文の長い列である" * 3 + " end"]
    plain = [plain_fingerprint(t) for t in texts]
    prints = fingerprints(texts)
    over = []
    for i in range(len(texts)):
        for j in range(len(texts)):
            if texts[i] and texts[j]:
                want = sum(a == b for a, b in zip(plain[i], plain[j], strict=True)) / len(plain[i])
                over.append(likeness(prints[i], prints[j]) - want)
    # a function keeps a byte of its tuple's hash, so that 1 in 256 agree by chance and equal tuples always
    assert min(over) > -1e-9 and max(over) < 0.08 and sum(over) / len(over) < 0.008


def test_many_ranges_and_odd_ids(spark):
    r = random.Random(4)
    rows = [(r.choice([i, i * 10**9, -i * 10**15, 2**63 - 1 - i]), f"text number {i} of them") for i in range(300)] + [(None, "n"), (-(2**63), "least")]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        got = {r["doc_id"]: r for r in order_minhash(spark.createDataFrame(rows, SCHEMA)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    uniq = {i: t for i, t in rows}
    line = sorted(((i, t) for i, t in rows if i is not None), reverse=True) + [(None, "n")]
    if len(uniq) == len(rows):
        for k, (i, t) in enumerate(line):
            e = edited_text(t, line[(k + 1) % len(line)][1])
            assert got[i]["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest(), i


def test_likeness_falls_with_the_edits_of_text_without_blanks():
    r = random.Random(6)
    for letters in ("的一是不了人我在有他这中大来上个国到说们", "abcdefghijklmnopqrstuvwxyz0123456789+/"):
        text, seen = [r.choice(letters) for _ in range(5000)], []
        whole = fingerprints(["".join(text)])[0]
        for edits in (1, 50, 500, 5000):
            t = list(text)
            for i in r.sample(range(5000), edits):
                t[i] = r.choice(letters)
            seen.append(likeness(whole, fingerprints(["".join(t)])[0]))
        assert seen[0] > 0.9 and seen[0] > seen[1] > seen[2] > seen[3] and seen[3] < 0.1, seen
