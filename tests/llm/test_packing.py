import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tesselode.llm import bpe
from tesselode.llm.packing import SEQUENCE, UNIT, UNITS, cutting_stock, fillers, pack, plan

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lane string"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def hard_texts():
    r = random.Random(8)
    bits = ["don't", "we'll've", "'s", " 's", "''s", "it'S", "x'sx", "'re", "\n't", " ", "  ", "\t", "\n\n", "\r\n", " ", "　", "a", "Zé", "日本語", "12", "½", "٣", "!", "?!", "…", "🙂", "\U0001d4d0", "é", "_", "<|endoftext|>", "'", "'l", "'ll", "'v", "\x1c", "\x85", "ſ's", "<|endo", "ftext|>"]
    texts = ["".join(r.choice(bits) for _ in range(r.randint(1, 30))) for _ in range(3000)]
    return texts + ["", " ", "  ", "'", "'s", "a'", "\n", "x" * 5000, " " * 700 + "a", "ab'd " * 100]


def test_ids_equal_the_tokenizer(tokenizer, sf, spark):
    texts = hard_texts() + [r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    encoder = bpe.PieceEncoder(PATH)
    for _ in range(2):  # the second time from memory
        got = [flat[at[i] : at[i + 1]].tolist() for _, flat, at in encoder.encode_column(pa.array(texts)) for i in range(len(at) - 1)]
        want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
        bad = [i for i in range(len(texts)) if got[i] != want[i]]
        assert len(got) == len(texts) and not bad, (texts[bad[0]][:200], got[bad[0]][:20], want[bad[0]][:20])


def test_literals_of_special_tokens_within_texts_alone(tokenizer):
    texts = ["a <|endoftext|> b", "<|endo", "ftext|>", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "", "<|endoftext|", ">"]
    got = [flat[at[i] : at[i + 1]].tolist() for _, flat, at in bpe.PieceEncoder(PATH).encode_column(pa.array(texts)) for i in range(len(at) - 1)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts] and 50256 in got[0]


def test_a_full_memory_forgets_but_never_errs(tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "SLOTS", 16)
    encoder = bpe.PieceEncoder(PATH)
    texts = [" ".join(f"w{i * 37 % 101}q{i}" for i in range(k, k + 40)) for k in range(50)]
    for _ in range(2):
        got = [flat[at[i] : at[i + 1]].tolist() for _, flat, at in encoder.encode_column(pa.array(texts)) for i in range(len(at) - 1)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_cutting_stock_is_near_the_volume_bound():
    r = random.Random(4)
    for _ in range(5):
        demand = [r.randint(0, 3000) for _ in range(UNITS - 1)]
        solution = cutting_stock(demand)
        assert np.allclose(sum(p * t for p, t in solution), demand, atol=1e-4)
        bound = sum((c + 1) * d for c, d in enumerate(demand)) / UNITS
        # heads above half a sequence need one each, those of just half a sequence half of one
        assert sum(t for _, t in solution) <= max(bound, sum(demand[UNITS // 2 :]) + demand[UNITS // 2 - 1] / 2) * 1.06
        patterns, bins = plan(demand)
        total = sum((u * p for u, p in patterns), np.zeros(UNITS - 1, int))
        assert all((p @ np.arange(1, UNITS)) <= UNITS for _, p in patterns)
        assert (total + [sum(b.count(c) for b in bins) for c in range(1, UNITS)] == demand).all()
        assert all(sum(b) <= UNITS for b in bins) and len(bins) < 60


def test_fillers_are_few_and_fill_every_gap():
    r = random.Random(6)
    for longest in (40, 700, 2047):
        sizes = [[r.randint(1, longest) for _ in range(r.randint(0, 30))] for _ in range(40)]
        counts = np.array([np.bincount([-(-x // UNIT) for x in g], minlength=UNITS + 1)[1:] for g in sizes])
        ids = np.array([sum(g) for g in sizes])

        def missing(k):
            patterns, bins = plan(counts[k:].sum(axis=0))
            return SEQUENCE * (sum(u for u, _ in patterns) + len(bins)) - ids[k:].sum() - ids[:k].sum()

        k = fillers(counts, ids)
        assert missing(k) <= 0 and (k == 0 or missing(k - 1) > 0)


def check(rows, got, tokenizer):
    ids = Counter()
    for i, t, _ in rows:
        ids[(i, *tokenizer.encode(t or "", add_special_tokens=False).ids, 1)] += 1
    pieces, seqs = defaultdict(list), defaultdict(list)
    for g in got:
        pieces[(g["doc_id"], g["doc_tokens"])].append((g["start"], g["length"], g["ids_crc32"]))
        seqs[g["sequence_id"]].append((g["offset"], g["length"]))
    for s in seqs.values():
        s.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(s, s[1:], strict=False)) and s[0][0] == 0 and s[-1][0] + s[-1][1] <= 2048
    for (i, *x), times in ids.items():
        mine = pieces[(i, len(x))]
        crc = Counter((s, n, zlib.crc32(np.array(x[s : s + n], "<u4").tobytes())) for s, n, _ in mine)
        have = Counter(mine)
        covered = Counter(k for (s, n, c) in have for k in range(s, s + n) if (s, n, c) in crc for _ in range(have[(s, n, c)]))
        if len([1 for (j, *y) in ids if j == i and len(y) == len(x)]) == 1:
            assert set(covered) == set(range(len(x))) and set(covered.values()) == {times}
    total = sum(g["length"] for g in got)
    assert total == sum(len(k) - 1 for k in ids.elements())
    waste = 0
    for s in seqs.values():
        n = s[-1][0] + s[-1][1]
        waste += 0 if n & (n - 1) == 0 else 2048 - n
    return waste / total


def test_documents(spark, tokenizer):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "text", "lang lane")
    assert check([tuple(r) for r in docs.collect()], pack(docs, PATH).collect(), tokenizer) < 0.001


def test_documents_of_one_sequence_stay_whole_beside_longer_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pieces = Counter((g["doc_id"], g["doc_tokens"]) for g in pack(docs, PATH).collect())
    cut = [k for k, n in pieces.items() if n > 1 and k[1] <= SEQUENCE]
    assert len(pieces) == docs.count() and len(cut) <= 2


def test_patterns_with_gaps_are_filled(spark, tokenizer):
    rows = [(i, "a b c d e f g h " * 130 + "x " * (i % 60), None) for i in range(40)] + [(100 + i, "t " * (i % 63), None) for i in range(400)]
    assert check(rows, pack(spark.createDataFrame(rows, SCHEMA), PATH).collect(), tokenizer) < 0.6


def test_small_odd_tables(spark, tokenizer):
    rows = [(i, "word " * n, None) for i, n in enumerate([0, 1, 63, 64, 65, 127, 2047, 2048, 2049, 5000, 3, 3])] + [(50, None, None), (None, "x y", "z"), (51, "same", "a"), (51, "same", "a")]
    check(rows, pack(spark.createDataFrame(rows, SCHEMA), PATH).collect(), tokenizer)
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0
    assert check([(1, "one", None)], pack(spark.createDataFrame([(1, "one", None)], SCHEMA), PATH).collect(), tokenizer) == 0
