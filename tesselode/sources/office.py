"""A data source for word-processing and spreadsheet files: spark.read.format("office").load(folder).

Files are spread over partitions by their bytes. A file is opened in place, its parts are read as streams and given row by row, so
that a task holds a row, and of a spreadsheet its table of shared texts. Files are read and written with pyarrow's file systems.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Where the parts of a file lie in it.
BODY, SHARED, SHEET = "word/document.xml", "xl/sharedStrings.xml", r"xl/worksheets/(sheet([^/]*)\.xml)"
#: Bytes of files in a partition, and of a part when it is unpacked.
PARTITION_BYTES, PART_BYTES = 64 << 20, 1 << 30
SCHEMA = "path string, kind string, part string, row long, cells array<string>, error string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path)


def _tag(element: ET.Element) -> str:
    return element.tag.rsplit("}", 1)[-1]


def _part(archive: zipfile.ZipFile, name: str):
    if archive.getinfo(name).file_size > PART_BYTES:
        raise ValueError(f"{name} has more than {PART_BYTES} bytes")
    return archive.open(name)


def _elements(archive: zipfile.ZipFile, name: str, wanted: str) -> Iterator[ET.Element]:
    """The outermost elements of a name in a part, each forgotten after it was looked at."""
    depth, parents = 0, []
    with _part(archive, name) as stream:
        for event, element in ET.iterparse(stream, ("start", "end")):
            own = _tag(element) == wanted
            if event == "start":
                depth += own
                parents.append(element)
                continue
            parents.pop()
            depth -= own
            if depth == 0:
                if own:
                    yield element
                element.clear()
                if parents:
                    parents[-1].remove(element)


def _shared(archive: zipfile.ZipFile) -> list[str]:
    if SHARED not in archive.namelist():
        return []
    return ["".join(t.text or "" for t in item.iter() if _tag(t) == "t") for item in _elements(archive, SHARED, "si")]


def _cell(cell: ET.Element, shared: list[str]) -> str:
    if cell.get("t") == "inlineStr":
        return "".join(t.text or "" for t in cell.iter() if _tag(t) == "t")
    value = next(((v.text or "").strip() for v in cell if _tag(v) == "v"), "")
    if cell.get("t") == "s" and value.isdigit():
        return shared[int(value)] if int(value) < len(shared) else ""
    return value


def rows_of(archive: zipfile.ZipFile) -> Iterator[tuple[str, str, int, list[str]]]:
    """(kind, part, row, cells) of an open file: a row for each paragraph or each row of each sheet, sheets by their number."""
    names = archive.namelist()
    body = next((n for n in names if n.lower() == BODY), None)
    if body:
        for i, paragraph in enumerate(_elements(archive, body, "p")):
            yield "docx", body, i, ["".join(paragraph.itertext())]
        return
    sheets = sorted(((int(m[2]) if m[2].isdigit() else 999, n, m[1]) for n in names if (m := re.fullmatch(SHEET, n))), key=lambda x: (x[0], x[1]))
    if not sheets:
        raise ValueError("neither a text nor a worksheet")
    shared = _shared(archive)
    for _, name, part in sheets:
        for i, row in enumerate(_elements(archive, name, "row")):
            cells = [_cell(c, shared) for c in row if _tag(c) == "c"]
            if cells:
                yield "xlsx", part, i, cells


class Files(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class OfficeReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[Files]:
        system, inside = opened(self.path)
        found = system.get_file_info(inside)
        listed = [found] if found.is_file else system.get_file_info(fs.FileSelector(inside, recursive=True))
        files = sorted((f.path, f.size or 0) for f in listed if f.is_file and f.path.lower().endswith((".docx", ".xlsx")))
        out, held = [], PARTITION_BYTES
        for name, size in files:
            if held + size > PARTITION_BYTES:
                out.append(Files([]))
                held = 0
            out[-1].paths.append(name)
            held += size
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[tuple]:
        """Rows of a file; one that cannot be read, or only in part, ends with a row that holds the error."""
        system, _ = opened(self.path)
        for path in partition.paths:
            try:
                with system.open_input_file(path) as f, zipfile.ZipFile(f) as archive:
                    for kind, part, row, cells in rows_of(archive):
                        yield path, kind, part, row, cells, None
            except (zipfile.BadZipFile, ET.ParseError, ValueError, KeyError, NotImplementedError, RuntimeError, EOFError) as e:
                yield path, path.rsplit(".", 1)[-1].lower(), None, None, None, f"{type(e).__name__}: {e}"


class OfficeSource(DataSource):
    """Rows (path, kind, part, row, cells, error) of the .docx and .xlsx files under a folder, or of one file."""

    @classmethod
    def name(cls) -> str:
        return "office"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OfficeReader:
        return OfficeReader(self.options["path"])


def read_office(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(OfficeSource)
    return spark.read.format("office").load(path)


def text_of(cells: Column) -> Column:
    """A row as one line of text: cells with bars between them."""
    return F.array_join(cells, "|", "")


# what XML cannot hold is left out
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]")


def _xml(text: str) -> str:
    return escape(_CONTROL.sub("", text), {"\r": "&#13;"})


def write_office(rows: DataFrame, folder: str) -> DataFrame:
    """(path, n_rows) of the files written for rows(file, row, cells), one for each file name; its ending, .docx or .xlsx, tells the kind.

    A file's rows are one group, by row; a file is put under its name when it is whole, so a task that runs again writes the same. Null cells are
    empty, null cell lists are rows without cells; a paragraph is its cells joined by blanks. Null names go.
    """

    def put(table: pa.Table) -> pa.Table:
        table = table.sort_by("row")
        name, cells = table.column("file")[0].as_py(), [[c or "" for c in x or []] for x in table.column("cells").to_pylist()]
        system, inside = opened(folder)
        system.create_dir(inside, recursive=True)
        path = f"{inside.rstrip('/')}/{name}"
        # the name of a trial is its own, as two runs of a task may write at once
        trial = f"{path}.{id(table)}.part"
        with system.open_output_stream(trial) as f, zipfile.ZipFile(f, "w", zipfile.ZIP_DEFLATED) as archive:
            if name.lower().endswith(".docx"):
                body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{_xml(" ".join(c))}</w:t></w:r></w:p>' for c in cells)
                archive.writestr(BODY, f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
            else:
                shared = {c: i for i, c in enumerate(dict.fromkeys(c for row in cells for c in row))}
                space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
                archive.writestr(SHARED, f"<sst {space}>" + "".join(f'<si><t xml:space="preserve">{_xml(c)}</t></si>' for c in shared) + "</sst>")
                body = "".join("<row>" + "".join(f'<c t="s"><v>{shared[c]}</v></c>' for c in row) + "</row>" for row in cells)
                archive.writestr("xl/worksheets/sheet1.xml", f"<worksheet {space}><sheetData>{body}</sheetData></worksheet>")
        system.move(trial, path)
        return pa.table({"path": [path], "n_rows": pa.array([len(cells)], pa.int64())})

    return rows.where("file IS NOT NULL").select("file", "row", "cells").groupBy("file").applyInArrow(put, "path string, n_rows long")
