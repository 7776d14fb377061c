"""Office files: rows of paragraphs and sheets, shared and own texts, files that are broken."""

import zipfile

from tesselode.sources import office as O


def test_written_files_come_back(spark, tmp_path):
    cells = [["a", "b <&>\"'"], ["", "é x"], [], None, [None, "  two  "], ["a\x01b\rc", "a"]]
    rows = [(f, i, c, "extra") for f in ("x.docx", "y.xlsx") for i, c in enumerate(cells)] + [(None, 1, ["z"], "extra")]
    folder = f"file:{tmp_path}/out"
    df = spark.createDataFrame(rows, "file string, row int, cells array<string>, path string").repartition(3)
    assert sorted(x.n_rows for x in O.write_office(df, folder).collect()) == [6, 6]
    back = O.read_office(spark, folder).orderBy("kind", "row").collect()
    assert [x.cells for x in back if x.kind == "docx"] == [["a b <&>\"'"], [" é x"], [""], [""], ["   two  "], ["ab\rc a"]]
    assert [(x.row, x.cells) for x in back if x.kind == "xlsx"] == [(0, cells[0]), (1, cells[1]), (4, ["", "  two  "]), (5, ["ab\rc", "a"])]
    assert {x.error for x in back} == {None}
    assert O.write_office(df.limit(0), f"{tmp_path}/none").count() == 0


def test_sheets_cells_and_broken_files(spark, tmp_path, monkeypatch):
    s = '<worksheet xmlns="urn:s"><sheetData>{}</sheetData></worksheet>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet10.xml", s.format('<row><c><v> 7 </v></c></row>'))
        z.writestr("xl/worksheets/sheet2.xml", s.format('<row><c t="s"><v>1</v></c><c t="s"><v>9</v></c><c t="inlineStr"><is><t>own</t></is></c><c><f>A1+1</f><v>3</v></c><c/></row><row/>'))
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="urn:s"><si><t>zero</t></si><si><r><t>o</t></r><r><t>ne</t></r></si></sst>')
    with zipfile.ZipFile(tmp_path / "b.docx", "w") as z:
        z.writestr("Word/Document.xml", "<d><tbl><p>in a table</p></tbl><p><r>one </r><r>two</r></p><p/></d>")
    with zipfile.ZipFile(tmp_path / "c.docx", "w") as z:
        z.writestr("word/document.xml", "<d><p>kept</p><p>")
    with zipfile.ZipFile(tmp_path / "d.xlsx", "w") as z:
        z.writestr("other.xml", "<x/>")
    (tmp_path / "e.docx").write_bytes(b"no archive" * 10)
    (tmp_path / "g.docx").write_bytes(b"short")
    (tmp_path / "f.txt").write_text("not read")
    got = {}
    for x in O.read_office(spark, str(tmp_path)).collect():
        got.setdefault(x.path[-6:], []).append((x.part, x.row, x.cells, x.error and x.error.split(":")[0]))
    assert got["a.xlsx"] == [("sheet2.xml", 0, ["one", "", "own", "3", ""], None), ("sheet10.xml", 0, ["7"], None)]
    assert [x[2] for x in got["b.docx"]] == [["in a table"], ["one two"], [""]]
    assert [(x[2], x[3]) for x in got["c.docx"]] == [(["kept"], None), (None, "ParseError")]
    assert [x[3] for x in got["d.xlsx"]] == ["ValueError"] and [x[3] for x in got["e.docx"]] == ["BadZipFile"] and [x[3] is None for x in got["g.docx"]] == [False]
    assert set(got) == {"a.xlsx", "b.docx", "c.docx", "d.xlsx", "e.docx", "g.docx"}
    monkeypatch.setattr(O, "PARTITION_BYTES", 1)
    assert len(O.OfficeReader(str(tmp_path)).partitions()) == 6
    assert O.read_office(spark, str(tmp_path / "b.docx")).count() == 3
