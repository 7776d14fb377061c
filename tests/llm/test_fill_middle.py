import hashlib
import random

import pyarrow as pa
import pytest

from tesselode.llm import fill_middle as M
from tesselode.llm import textcore as tc

SCHEMA = "doc_id long, text string, form string, OUTPUT string"


def draws(doc_id, seed=1):
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]


def plain(doc_id, text, units=list, rate=90, spm=20):
    text = text or ""
    u, (h1, h2, h3, h4) = units(text), draws(doc_id)
    n = len(u)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    x, y, z = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", a, b - a, f"<S>{z}<P>{x}<M>{y}") if h4 % 100 < spm else (n, "psm", a, b - a, f"<P>{x}<S>{z}<M>{y}")


def lines(text):
    out = text.split("\n")
    return [x + "\n" for x in out[:-1]] + ([out[-1]] if out[-1] else [])


def rows(n=400):
    r = random.Random(3)
    bits = ["a", "é", "漢", "😀", "<", ">", "P", "S", "M", "<P", "<S>", "\n", "\r\n", " ", "z" * 9, "\u0301", "\x00"]
    out = [(i, "".join(r.choice(bits) for _ in range(r.randrange(0, 14))), "x", "y") for i in range(n)]
    return out + [(1000, None, "x", None), (1001, "", None, None), (None, "no id", "x", "y"), (5, "twice", "x", "y"), (5, "twice", "x", "y"), (2000, "漢字かな" * 300_000, "x", "y"), (2001, "<" * 70_000, "x", "y")]


@pytest.mark.parametrize("unit", ["char", "line"])
def test_against_plain_and_back(spark, unit):
    data = rows()
    got = M.restore(M.fill_in_middle(spark.createDataFrame(data, SCHEMA), unit=unit)).collect()
    key = lambda x: (x[0] is None, x[0] or 0, x[1:])
    want = [(i, *plain(i, t, list if unit == "char" else lines), t or "") for i, t, _, _ in data]
    assert sorted((tuple(x) for x in got), key=lambda x: repr(key(x))) == sorted(want, key=lambda x: repr(key(x)))
    assert {x.form for x in got} == {"plain", "psm", "spm"}


def test_rates_and_empty(spark):
    data = [(i, "some text here", "x", "y") for i in range(60)]
    df = spark.createDataFrame(data, SCHEMA)
    assert {x.form for x in M.fill_in_middle(df, rate=0).collect()} == {"plain"}
    assert {x.form for x in M.fill_in_middle(df, rate=100, spm=100).collect()} == {"spm"}
    assert M.restore(M.fill_in_middle(df.limit(0))).collect() == []


def test_automaton_step_by_step():
    data = "".join(t or "" for _, t, _, _ in rows(200)).encode()[:5000] + bytes([0x80, 0xC3, 0x41, 0xF0, 0x9F, 0x80, 0x80, 0x80, 0x80, 0xE2])
    column = pa.array([data, b"", data[::-1]], pa.large_binary()).view(pa.large_string())
    raw, at = tc.texts_of(column)
    want = []
    for a, b in zip(at, at[1:]):
        state = M.START
        for kind in M._CLASS[raw[a:b]].tolist():
            state, emits = M.step(state, kind)
            want.append(emits)
    assert M.scan(raw, at).tolist() == want


def test_a_broken_output_is_an_error(spark):
    df = spark.createDataFrame([("psm", "<P>a<S>b")], "form string, output string")
    with pytest.raises(Exception, match="2 sentinels"):
        M.restore(df).collect()
