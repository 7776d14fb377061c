"""The rules one by one, the prefilter against none, hostile texts, reports."""

import random
import time

import pyarrow as pa
import pyarrow.compute as pc

from tesselode.functions.security_rules import RULES
from tesselode.operators import security as S
from tesselode.plans.security_queries import PLANTED

FILE = "path string, language string, content string, rule string"


def plain(text, language):
    return [r for r, (_, lang, _, pattern, _) in enumerate(RULES) if lang in ("all", language) and pc.find_substring_regex(pa.array([text]), pattern)[0].as_py() >= 0]


def test_each_rule_finds_its_line(spark):
    rows = [(str(i), r[1] if r[1] != "all" else "java", f"head é\nline\n{p}\ntail\nmore", "x") for i, (r, p) in enumerate(zip(RULES, PLANTED, strict=True))]
    got = S.findings(spark.createDataFrame(rows, FILE)).collect()
    for i in range(len(RULES)):
        own = [g for g in got if g["path"] == str(i) and g["rule"] == i]
        assert len(own) == 1, (i, RULES[i])
        assert own[0]["line"] == 3 and own[0]["snippet"].startswith(PLANTED[i].split("\n")[0]) and own[0]["confidence"] == RULES[i][4]


def test_the_prefilter_loses_nothing():
    r, matcher = random.Random(9), S.Matcher(RULES)
    bits = [x for p in PLANTED for x in (p, p.upper(), p[: len(p) // 2], p[len(p) // 2 :])] + ["ſystem(", "paſſword = 'abc'", "\n", " ", "ſ", "K"]
    for _ in range(300):
        text = " ".join(r.choice(bits) for _ in range(r.randrange(4)))
        for language in ("python", "c", "go", "javascript", "java", "rust", "php", None):
            assert sorted(n for _, n, _ in matcher.matches([text], [language])) == plain(text, language), (text, language)


def test_hostile_and_odd_rows(spark):
    rows = [("open", "c", "(" * 25_000, "x"), ("stars", "go", "(a+" * 9_000, "x"), ("null", "c", None, "x"), ("empty", "c", "", "x"), ("none", None, "password = 'abcd'", "x"), ("twice", "c", "gets(a)", None), ("twice", "c", "gets(a)", None), (None, "c", "gets(a)", None)]
    began = time.time()
    got = sorted((g["path"] or "", g["name"]) for g in S.findings(spark.createDataFrame(rows, FILE)).collect())
    assert got == [("", "gets() call"), ("none", "hardcoded password string"), ("twice", "gets() call"), ("twice", "gets() call")] and time.time() - began < 30
    assert S.findings(spark.createDataFrame([], FILE)).count() == 0


def test_reports_and_paths(spark):
    rows = [("a.py", "python", "eval(x)\neval(y)", "x"), ("b.py", "python", "\n\nverify_ssl = false\nmd5(x)", "x")]
    found = S.findings(spark.createDataFrame(rows, FILE))
    assert [(g["path"], g["line"], g["severity"]) for g in S.select_findings(found).collect()] == [("a.py", 1, "MEDIUM"), ("b.py", 3, None), ("b.py", 4, "MEDIUM")]
    assert S.select_findings(found, "CWE-327").count() == 1 and S.select_findings(found, least=0.85).count() == 1 and S.select_findings(found, severity="HIGH").count() == 0
    assert {(m["what"], m["key"]): m["n"] for m in S.metrics(found).collect()} == {("total", ""): 3, ("cwe", "CWE-20"): 1, ("cwe", "CWE-1004"): 1, ("cwe", "CWE-327"): 1, ("severity", "HIGH"): 0, ("severity", "MEDIUM"): 2, ("severity", "LOW"): 0, ("language", "python"): 3}
    paths = spark.createDataFrame([("src/a.PY",), ("vendor/b.c",), ("x/build/b.c",), ("building/b.c",), ("n.txt",), ("build",), (None,)], "path string")
    assert [r[0] for r in paths.select(S.file_language(paths.path)).collect()] == ["python", None, None, "c", None, None, None]
