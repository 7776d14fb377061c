"""Readers and extraction on small inputs."""

from tesselode.sources import files as X


def test_tree_walk_and_symbols(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/m.py").write_text("class A(B):\n    def f(self):\n        return g(self.h())\n\nasync def k():\n    pass\n")
    (tmp_path / "a/bad.py").write_text("def (:\n")
    (tmp_path / "a/x.rs").write_text("pub fn run() {}\nstruct S;\n")
    (tmp_path / ".git/n.py").write_text("def hidden(): pass\n")
    (tmp_path / "a/notes.txt").write_text("def no(): pass\n")
    (tmp_path / "a/empty.py").write_text("")
    files = X.read_sources(spark, str(tmp_path))
    assert sorted((r["path"].rsplit("/", 1)[1], r["language"]) for r in files.collect()) == [("bad.py", "python"), ("m.py", "python"), ("x.rs", "rust")]
    got = sorted((r["kind"], r["qualified_name"], r["line_start"], r["line_end"], tuple(r["calls"]), tuple(r["bases"])) for r in X.python_symbols(files.where("language = 'python'")).collect())
    assert got == [("Class", "A", 1, 3, (), ("B",)), ("Function", "A.f", 2, 3, ("g", "h"), ()), ("Function", "k", 5, 6, (), ())]
    lines = X.line_symbols(files.where("language = 'rust'")).select("kind", "name", "line_start").collect()
    assert sorted(map(tuple, lines)) == [("Class", "S", 2), ("Function", "run", 1)]


def test_sections_of_odd_texts(spark):
    docs = spark.createDataFrame([(1, "intro\n# One\nx\ny\n## Two\n"), (2, None), (3, ""), (4, "#no heading"), (5, "# A\n# A\n")], "id long, text string")
    got = sorted(tuple(r) for r in X.sections(docs, "id", "text").collect())
    assert got == [(1, 0, 0, "", "intro", 1), (1, 1, 1, "One", "x\ny", 2), (1, 2, 2, "Two", "", 5), (4, 0, 0, "", "#no heading", 1), (5, 0, 1, "A", "", 1), (5, 1, 1, "A", "", 2)]


def test_ragged_table(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name,age\nann, 30\nbo\n"x, ""y""",1\n')
    assert sorted(map(tuple, X.read_table(spark, str(tmp_path / "t.csv")).collect())) == [("ann", "30"), ("bo", ""), ('x, "y"', "1")]


def test_numstat_lines(spark):
    lines = spark.createDataFrame([("3\t1\ta.go",), ("-\t-\tb.png",), ("commit x",), (None,), ("",)], "value string")
    assert sorted(map(tuple, X.numstat(lines).collect())) == [(0, 0, "b.png"), (3, 1, "a.go")]


def test_a_file_without_a_tree_is_told(spark, monkeypatch):
    rows = [("bad.py", "x = 1\ndef (:\n"), ("none.py", "x = 1\n"), ("deep.py", "x = " + "-" * 20_000 + "1\n"), ("nul.py", "a\0b"), ("ok.py", "class A" + "(B" + ".c" * 3000 + "):\n    pass\n")]
    got = {r["path"]: r for r in X.python_symbols(spark.createDataFrame(rows, "path string, content string"), failures=True).collect()}
    assert {p: r["kind"] for p, r in got.items()} == {"bad.py": "Unparsed", "deep.py": "Unparsed", "nul.py": "Unparsed", "ok.py": "Class"}
    assert got["bad.py"]["name"].startswith("SyntaxError: ") and got["bad.py"]["line_start"] == 2 and got["bad.py"]["calls"] is None
    monkeypatch.setattr("tesselode.plans.extract_queries._sources", lambda *_: spark.createDataFrame(rows, "path string, content string"))
    from tesselode.plans import extract_queries as Q

    assert sorted(r["path"] for r in Q.python_symbols(spark, "").collect() if r["kind"] == "Unparsed") == ["bad.py", "deep.py", "nul.py"]
