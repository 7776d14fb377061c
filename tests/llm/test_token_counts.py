import random

import public_tokenizers
from tokenizers import Tokenizer, models, pre_tokenizers

from tesselode.llm.token_counts import Counter, read_pieces, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")


def oracle(pieces):
    t = Tokenizer(models.Unigram(pieces, unk_id=0, byte_fallback=all(f"<0x{b:02X}>" in {p for p, _ in pieces} for b in range(256))))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always")
    return t


def test_counts_equal_the_library(spark, sf):
    t = oracle(read_pieces(PATH))
    r = random.Random(3)
    odd = ["", " ", "  ", " a", "a ", "a▁b", "日本語 テキスト", "🙂🙂 x", "\n\t", "ééé", "<0x41>", "<unk>", "x" * 300] + ["".join(r.choice("ab ét▁日🙂\n") for _ in range(r.randint(1, 40))) for _ in range(500)]
    rows = [(i, x, i) for i, x in enumerate(odd)] + [(1000 + x["doc_id"], x["text"], 0) for x in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    docs = spark.createDataFrame([*rows, (None, "a", 1), (-1, None, 1), (-2, "a b", 1), (-2, "a b", 1)], "doc_id long, text string, n_tokens_before int")
    got = token_counts(docs, PATH).collect()
    assert len(got) == len(rows) + 4
    n = {x["doc_id"]: x["n_tokens"] for x in got}
    for i, x, _ in rows:
        assert n[i] == len(t.encode(x, add_special_tokens=False).ids), repr(x[:80])
    assert n[-1] == 0 and n[-2] == len(t.encode("a b").ids)
    assert token_counts(docs.where("false"), PATH).count() == 0


def test_ties_and_unknowns_without_bytes():
    r = random.Random(9)
    for _ in range(20):
        names = ["<unk>"] + sorted({"".join(r.choice("▁abc") for _ in range(r.randint(1, 4))) for _ in range(r.randint(3, 25))})
        pieces = [(p, float(-r.randint(0, 4))) for p in names]
        t, c = oracle(pieces), Counter(pieces)
        for _ in range(60):
            w = "".join(r.choice("abcd") for _ in range(r.randint(1, 9)))
            assert c.count("▁" + w) == len(t.encode(w, add_special_tokens=False).ids), (w, pieces)


def test_a_long_text_without_blanks_needs_little_room():
    """A ring of the longest piece: beside the automaton's own copy of 4 bytes a character, the peak does not grow with the word."""
    import tracemalloc

    r, peaks = random.Random(2), []
    c = Counter([("<unk>", 0.0), ("▁", -1.0), ("ab", -1.5), ("abc", -1.0), ("c", -2.0), ("日本", -1.0)])
    for n in (20_000, 400_000):
        word = "▁" + "".join(r.choice("abc日本語") for _ in range(n))
        tracemalloc.start()
        c.count(word)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] - peaks[0] < 4.1 * 380_000


def test_long_words_equal_the_library():
    t, c, r = oracle(read_pieces(PATH)), Counter.of(PATH), random.Random(7)
    for letters in ("abcdefghij", "日本語テキスト", "a日🙂é"):
        word = "".join(r.choice(letters) for _ in range(20_000))
        assert c.count("▁" + word) == len(t.encode(word, add_special_tokens=False).ids)
