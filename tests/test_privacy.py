"""Numbered names, replaced texts and the ladder against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from tesselode.operators import privacy as P


def plain(text, tokens):
    """Each name replaced in turn, the longest first; tokens are held back as characters that no name has."""
    marks = {}
    for i, name in enumerate(sorted(tokens, key=lambda n: (-len(n.encode()), n))):
        marks[chr(0xE000 + i)] = tokens[name]
        text = text.replace(name, chr(0xE000 + i))
    return "".join(marks.get(c, c) for c in text)


def test_replaced_equals_plain_replacing_in_any_number_of_blocks(spark):
    r = random.Random(3)
    tokens = {n: f"VAR_{i}" for i, n in enumerate({"".join(r.choice("abé") for _ in range(r.randrange(1, 6))) for _ in range(60)} | {"V", "R_1", "aaaa"})}
    texts = [(i, "".join(r.choice("abéxV_R1 ") for _ in range(r.randrange(80))), i) for i in range(200)] + [(200, None, 1), (201, "", 1), (7, "aé", 1), (202, "aé" * 50_000, 1)]
    df = spark.createDataFrame(texts, "id int, text string, token int")
    names = spark.createDataFrame([*tokens.items(), ("", "X"), (None, "Y")], "name string, token string")
    want = sorted((i, t if t is None else plain(t, tokens), k) for i, t, k in texts if i < 202)
    for block in (1 << 20, 1500, 200):
        got = [tuple(x) for x in P.replaced(df, names, block_bytes=block).collect()]
        assert sorted(x for x in got if x[0] < 202) == want
        assert [x[1] for x in got if x[0] == 202] == [plain("aé" * 50_000, tokens)]
    assert [x.text for x in P.replaced(df, names.limit(0)).orderBy("id", "text").collect()] == [x.text for x in df.orderBy("id", "text").collect()]
    with pytest.raises(ValueError):
        P.replaced(df, names, block_bytes=10)


def test_numbered_follows_first_sightings(spark):
    r = random.Random(4)
    rows = [(f"n{r.randrange(300)}", r.choice(["FUNC", "FUNC", "VAR"]), r.randrange(50)) for _ in range(2000)]
    df = spark.createDataFrame([*rows, (None, "VAR", 1), ("", "VAR", 1), ("k", None, 1), ("k", "VAR", None)], "name string, kind string, seen int")
    first = {}
    for name, kind, seen in rows:
        first[name] = min(first.get(name, (seen, kind)), (seen, kind))
    want, counts = {}, {}
    for (seen, kind), name in sorted(((v, k) for k, v in first.items()), key=lambda x: (x[0][1], x[0][0], x[1])):
        counts[kind] = counts.get(kind, 0) + 1
        want[name] = (kind, f"{kind}_{counts[kind]}")
    got = {x.name: (x.kind, x.token) for x in P.numbered(df.repartition(7)).collect()}
    assert got == want
    assert P.numbered(df.limit(0)).count() == 0


def test_ladder(spark):
    texts = [(1, "password = hunter2hunter launchCode"), (2, "a launchCode b"), (3, "/vault/x"), (4, "not at the start /vault/x"), (5, "see /home/me/a.py now"), (6, "/srv/open/b.py stays"), (7, "ééé" * 10), (8, None), (9, ""), (10, "one  two three four five six")]
    df = spark.createDataFrame(texts, "id int, text string").withColumn("reasons", F.lit("mine"))
    p = P.Policy("MASKED", ["launchCode"], ["/vault/"], ["/srv/open/"], max_source_bytes=29, max_words=4)
    names = spark.createDataFrame([("see", "VAR_1"), ("é", "VAR_2")], "name string, token string")
    got = {x.id: (x.allowed, x.sanitized, x.reasons) for x in P.sanitized(df, p, names).collect()}
    assert got[1] == (False, "password = ***REDACTED*** launchCode", ["secret detected"])
    assert got[2] == (False, "***FORBIDDEN_IDENTIFIER***", ["forbidden identifier present"])
    assert got[3] == (False, "***FORBIDDEN_PATH***", ["forbidden path present"])
    assert got[4] == (True, "not at the start...", ["max context tokens exceeded"])
    assert got[5] == (True, "VAR_1 ***PATH*** now", ["path not allowed"])
    assert got[6] == (True, "/srv/open/b.py stays", [])
    assert got[7] == (True, "VAR_2" * 14 + "...", ["max source bytes exceeded"])
    assert got[8] == got[9] == (True, "", [])
    assert got[10] == (True, "one two three four...", ["max context tokens exceeded"])
    local = P.sanitized(df, P.Policy("LOCAL_ONLY")).first()
    assert (local.allowed, local.sanitized, local.reasons) == (False, "***LOCAL_ONLY***", ["privacy mode is LOCAL_ONLY"])
    with pytest.raises(ValueError):
        P.Policy("OPEN")
