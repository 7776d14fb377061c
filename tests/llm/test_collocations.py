import random
import re
from collections import Counter

import numpy as np

from tesselode.llm import collocations as C
from tesselode.llm import textcore as tc

SCHEMA = "rank string, text string, lang string, N long"
AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top, least):
    f, total = Counter(), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(AZ)):
            w = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    gone = {(g, p[i:j]) for (g, p), n in cand.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if j - i < len(p) and 100 * n >= 80 * f[g, p[i:j]]}
    out = []
    for g in total:
        own = []
        for (lang, p), a in cand.items():
            if lang == g and (lang, p) not in gone:
                score, k = min((2_000_000 * a // (f[g, p[:k]] + f[g, p[k:]]), k) for k in range(1, len(p)))
                own.append((-score, -a, " ".join(p).encode(), f[g, p[:k]], f[g, p[k:]]))
        own.sort()
        out += [(g, i, p.decode(), -a, left, right, total[g], -s) for i, (s, a, p, left, right) in enumerate(own[:top], 1)]
    return sorted(out)


def run(spark, rows, **more):
    got = C.collocations(spark.createDataFrame(rows, SCHEMA), **more)
    return sorted(tuple(r) for r in got.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def test_against_plain(spark):
    r = random.Random(5)
    words = ["the", "of", "Fox", "red", "é", "word", "neu", "x"]
    rows = [("c", "".join(r.choice(words) + r.choice([" ", " ", "\t", "  ", ". ", "\n", "!"]) for _ in range(r.randrange(0, 60))), r.choice(["en", "en", "en", "de", None, "und"]), 1) for _ in range(150)]
    rows += [("c", "new york city hall is here", "en", 1)] * 12 + [("c", None, "en", 1), ("c", "", "xx", 1), ("c", "only three words", "fr", 1), ("c", "?!", "fr", None)]
    for top, least in ((2000, 3), (5, 2), (7, 1)):
        want = plain(rows, top, least)
        assert want and run(spark, rows, top=top, least=least) == want


def test_a_long_piece_repeats_and_empty(spark):
    rows = [("c", "a b " * 4000, "en", 1), ("c", "q" * 3_000_000 + " b a", "en", 1), ("c", "a b", None, 1)]
    assert run(spark, rows, least=30) == plain(rows, 2000, 30)
    assert run(spark, rows, least=10**6) == []
    assert run(spark, []) == []


def test_products_beyond_64_bits(spark):
    big = spark.sql("SELECT 9000000000000000000L AS a, 9000000000000000000L AS l, 9000000000000000001L AS r")
    assert big.select(C._over(big.a, big.l.cast("decimal(19,0)") + big.r)).first()[0] == 2_000_000 * 9 * 10**18 // (18 * 10**18 + 1)


def test_chunks_end_at_pieces_or_documents():
    texts = ["a b. c d e f", "", "no stop at all in this one text", "x, y; z", ""]
    raw, at = tc.texts_of(__import__("pyarrow").array(texts))
    for limit in (1, 3, 7, 12, 100):
        seen = {}
        for first, part, offsets in C.chunks(raw, at, limit):
            for i, (a, b) in enumerate(zip(offsets, offsets[1:])):
                piece = part[a:b].tobytes().decode()
                seen.setdefault(first + i, []).append(piece)
        assert ["".join(seen.get(i, [])) for i in range(len(texts))] == texts
        for i, cut in seen.items():
            assert all(c[-1] in ".,;" for c in [c for c in cut if c][:-1]), (limit, i, cut)


def test_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 50_000, dtype=np.uint64))
    table = C.PerfectHash(keys)
    slots = table.slots(keys)
    assert sorted(slots.tolist()) == list(range(len(keys))) and (table.stored[slots] == keys).all()
    assert (table.slots(keys + np.uint64(1))[~np.isin(keys + np.uint64(1), keys)] == -1).all()
    assert len(C.PerfectHash(keys[:0]).slots(keys)) == len(keys)
