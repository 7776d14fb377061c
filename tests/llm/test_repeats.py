import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tesselode.llm.rlz_dedup import rlz_dedup
from tesselode.llm.suffix_dedup import suffix_dedup

SCHEMA = "doc_id long, text string, lang string"


def brute(rows, tokens, window, strict):
    """(n, removed, spans, kept tokens) by (id, text), from every window of every document."""
    first, uniq = {}, sorted({(i, t) for i, t, _ in rows if i is not None and t is not None})
    for i, t in uniq:
        k = tokens(t)
        for p in range(len(k) - window + 1):
            w = tuple(k[p : p + window])
            first[w] = min(first.get(w, (i, p)), (i, p))
    out = {}
    for i, t, _ in rows:
        k = tokens(t or "")
        gone = [False] * len(k)
        if i is not None:
            for p in range(len(k) - window + 1):
                f = first[tuple(k[p : p + window])]
                if (f[0] < i) if strict else (f < (i, p)):
                    gone[p : p + window] = [True] * window
        spans = sum(g and not (j and gone[j - 1]) for j, g in enumerate(gone))
        out[(i, t)] = (len(k), sum(gone), spans, [x for x, g in zip(k, gone) if not g])
    return out


def fixture_rows():
    r = random.Random(5)
    words = ["w%d" % i for i in range(60)] + ["é", "日本", "the", "the", "the"]
    base = [" ".join(r.choice(words) for _ in range(r.randint(20, 200))) for _ in range(12)]
    rows = []
    for i in range(60):
        a, b = r.choice(base), r.choice(base)
        x, y = r.randint(0, len(a)), r.randint(0, len(b))
        t = a[x : x + r.randint(0, 400)] + r.choice([" ", "\n", "\x0b"]) + b[y : y + r.randint(0, 400)] + " " + " ".join(r.choice(words) for _ in range(r.randint(0, 40)))
        rows.append((i - 7, t, "en"))
    rows += [(100, None, None), (101, "", "en"), (None, base[0], "en"), (102, base[0], None), (103, base[0], "x"), (103, base[0], "x")]
    rows += [(104, "ab" * 900, "x"), (105, "a" * 700, "y"), (106, "line of words here\n" * 60, "z"), (107, " ".join(["again"] * 90), "z")]
    rows += [(108, base[1] + " one", "a"), (108, base[2] + " two", "a")]
    return rows


@pytest.mark.parametrize("window", [100, 37])
def test_suffix_dedup_equals_brute_force(spark, window):
    rows = fixture_rows()
    want = brute(rows, lambda t: list(t.encode()), window, False)
    got = suffix_dedup(spark.createDataFrame(rows, SCHEMA), min_bytes=window).collect()
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append(g[2:])
    for (i, _), (n, gone, spans, kept) in want.items():
        assert (n, gone, spans, hashlib.sha256(bytes(kept)).hexdigest()) in by[i], (i, n, gone, by[i])


@pytest.mark.parametrize("window", [13, 6])
def test_rlz_dedup_equals_brute_force(spark, window):
    rows = fixture_rows()
    want = brute(rows, lambda t: t.encode().split(), window, True)
    got = rlz_dedup(spark.createDataFrame(rows, SCHEMA), min_words=window).collect()
    assert len(got) == len(rows)
    by = {}
    for g in got:
        by.setdefault(g["doc_id"], []).append(g[2:])
    for (i, _), (n, gone, spans, kept) in want.items():
        assert (n, gone, spans, hashlib.sha256(b" ".join(kept)).hexdigest()) in by[i], (i, n, gone, by[i])


def test_whole_documents_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    for op, tokens, window, strict, join in ((suffix_dedup, lambda t: list(t.encode()), 100, False, bytes), (rlz_dedup, lambda t: t.encode().split(), 13, True, b" ".join)):
        want = {i: (n, g, s, hashlib.sha256(join(k)).hexdigest()) for (i, _), (n, g, s, k) in brute(rows, tokens, window, strict).items()}
        got = {r["doc_id"]: (r["n_tokens"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in op(docs).collect()}
        assert got == want
        assert sum(v[1] for v in got.values()) > 0


def test_kept_text_extra_columns_and_empty_table(spark):
    rows = [(1, " ".join("w%d" % i for i in range(30)), "en", 7), (2, "x  y " + " ".join("w%d" % i for i in range(30)) + " z", "en", None), (3, "keep\n\nthis", None, 1)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_removed_before int").withColumn("open", F.lit("clash")).withColumn("part", F.lit(3))
    got = {r["doc_id"]: r for r in rlz_dedup(df, keep_text=True).collect()}
    assert got[2]["text"] == "x y z" and got[3]["text"] == "keep\n\nthis" and got[2]["open"] == "clash"
    empty = spark.createDataFrame([], SCHEMA)
    assert rlz_dedup(empty).count() == 0 and suffix_dedup(empty).count() == 0


@pytest.mark.parametrize("op", [rlz_dedup, suffix_dedup])
def test_clashing_names(spark, op):
    text = " ".join("w%d" % i for i in range(60))
    names = ["n_tokens", "n_removed", "n_spans", "kept_sha256", "part", "kind", "done", "__done", "__tx", "__found", "tx", "open"]
    df = spark.createDataFrame([(1, text, *"abcdefghijkl"), (2, text + " end", *"abcdefghijkl"), (3, None, *[None] * 12)], ["doc_id", "text", *names])
    for keep in (False, True):
        out = op(df, keep_text=keep)
        got = {r["doc_id"]: r for r in out.collect()}
        assert len(got) == 3 and sorted(out.columns) == sorted([c for c in df.columns if keep or c != "text"])
        assert got[1]["n_removed"] == 0 and got[2]["n_removed"] > 0 and got[3]["n_tokens"] == 0
        assert got[2]["__done"] == "h" and got[2]["part"] == "e" and got[3]["open"] is None


def test_windows_have_a_bound(spark):
    with pytest.raises(ValueError):
        rlz_dedup(spark.createDataFrame([], SCHEMA), min_words=70_000)
