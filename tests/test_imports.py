"""Imports by the rules of each language, on small trees."""

from pyspark.sql import functions as F

from tesselode.operators import imports as I


def edges(spark, paths, rows, **go):
    files = spark.createDataFrame([(p, 1) for p in paths], "path string, target int")
    return sorted((x.from_path, x.to_path) for x in I.resolved(spark.createDataFrame(rows, "path string, target string"), files, **go).collect())


def test_rules_of_each_language(spark):
    paths = ["a/b/c.py", "a/b/d.py", "a/b/__init__.py", "a/e.py", "a/x/__init__.py", "/abs/m.py", "/abs/n.py", "top.py", "lib/one/util.py", "lib/two/util.py", "w/i.ts", "w/j.tsx", "w/j.js", "w/k/index.js", "w/k.mjs", "jv/com/A.java", "s/m.rs", "s/n.rs", "s/o/mod.rs", "c/q.c", "c/q.h", "inc/sys/t.h", None]
    rows = [
        ("a/b/c.py", ".d"), ("a/b/c.py", "."), ("a/b/c.py", "..e"), ("a/b/c.py", "..x"), ("a/b/c.py", ".....top"), ("a/b/c.py", "b.d"), ("a/b/c.py", "x"), ("a/b/c.py", "one.util"), ("a/b/c.py", "util"), ("a/b/c.py", "top"), ("a/b/c.py", ".c"), ("/abs/m.py", ".n"), ("/abs/m.py", "..abs.n"),
        ("w/i.ts", "./j"), ("w/i.ts", "./j.js"), ("w/i.ts", "./k"), ("w/k/index.js", "../i"), ("w/i.ts", "j"), ("w/i.ts", "../../../w/j"),
        ("jv/com/A.java", "com.A"), ("w/X.java", "com.A"), ("w/X.java", "com.*"), ("s/m.rs", "n"), ("s/m.rs", "o"), ("c/q.c", "q.h"), ("c/q.c", "sys/t.h"), ("c/q.c", "stdio.h"), ("x.md", "a"), (None, "a"), ("a/b/c.py", None),
    ]
    want = {
        ("a/b/c.py", "a/b/d.py"), ("a/b/c.py", "a/b/__init__.py"), ("a/b/c.py", "a/e.py"), ("a/b/c.py", "a/x/__init__.py"), ("a/b/c.py", "top.py"), ("a/b/c.py", "lib/one/util.py"), ("/abs/m.py", "/abs/n.py"),
        ("w/i.ts", "w/j.tsx"), ("w/i.ts", "w/k.mjs"), ("w/k/index.js", "w/i.ts"), ("w/X.java", "jv/com/A.java"), ("s/m.rs", "s/n.rs"), ("s/m.rs", "s/o/mod.rs"), ("c/q.c", "c/q.h"), ("c/q.c", "inc/sys/t.h"),
    }
    assert edges(spark, paths, rows + rows[:3]) == sorted(want)
    assert edges(spark, [], rows) == edges(spark, paths, []) == []


def test_go_packages(spark):
    paths = [f"r/svc/p/f{i:02}.go" for i in range(30)] + ["r/svc/p/a_test.go", "r/other/svc/p/z.go", "r/main.go", "q/lone/a.go"]
    got = edges(spark, paths, [("r/main.go", "m.org/x/svc/p")], go_module="m.org/x", root="r")
    assert got == [("r/main.go", f"r/svc/p/f{i:02}.go") for i in range(20)]
    assert edges(spark, paths, [("r/main.go", "far/svc/p")]) == [("r/main.go", p) for p in sorted(p for p in paths if p.endswith(".go") and "/svc/p/" in p and "_test" not in p)[:20]]
    assert edges(spark, paths, [("r/main.go", "lone")]) == [("r/main.go", "q/lone/a.go")]
    assert edges(spark, paths, [("q/lone/a.go", "m.org/x")], go_module="m.org/x", root="r") == [("q/lone/a.go", "r/main.go")]


def test_lines_dead_and_generated(spark):
    files = [("a.py", "import os.path\nfrom .b import c\nimport re\nre.compile(path)\npaths b_b"), ("b.go", 'import (\n\t"fmt"\n\tx "m/y"\n)\nfmt.Print(y)'), ("c.rs", "pub mod k;\nmod z;\nk::f()"), ("d.js", "const a = require('./q');\nimport b from \"w\";\nq w"), ("e.py", None), ("f.md", "import x"), ("g.h", '#include "u/v.h"\n# include <w.h>')]
    df = spark.createDataFrame(files, "path string, content string")
    found = I.imports_of(df)
    assert sorted(map(tuple, found.collect())) == sorted([("a.py", "os.path"), ("a.py", ".b"), ("a.py", "re"), ("b.go", "fmt"), ("b.go", "m/y"), ("c.rs", "k"), ("c.rs", "z"), ("d.js", "./q"), ("d.js", "w"), ("g.h", "u/v.h"), ("g.h", "w.h")])
    assert sorted(map(tuple, I.dead_imports(df, found).collect())) == [("a.py", ".b"), ("c.rs", "z")]
    odd = spark.createDataFrame([("a.py", "c++ c++ a-b a-b"), ("b.py", "x*y a*b")], "path string, content string")
    rows = spark.createDataFrame([("a.py", "c++"), ("a.py", "a-b"), ("a.py", "Q\\Ez"), ("a.py", "x."), ("b.py", "*")], "path string, target string")
    assert sorted(map(tuple, I.dead_imports(odd, rows).collect())) == [("a.py", "Q\\Ez"), ("a.py", "c++")]
    marks = [("a.pb.go", ""), ("a.go", "// Code generated by x. DO NOT EDIT."), ("a.go", "\n" * 19 + "@generated"), ("a.go", "\n" * 20 + "@generated"), ("a.go", "é" * 1018 + " @generated"), ("a.go", "é" * 1019 + " @generated"), (None, None), ("x_mock.go", None)]
    got = [x.g for x in spark.createDataFrame([(i, *m) for i, m in enumerate(marks)], "i int, p string, c string").orderBy("i").select(I.generated(F.col("p"), F.col("c")).alias("g")).collect()]
    assert got == [True, True, True, False, True, False, False, True]
