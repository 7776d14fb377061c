"""Source trees, sections, CSV tables, nested binaries and change logs, read into frames.

Null texts count as empty. Texts that no rule fits give no rows.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselode.sources.tables import pieces

# Language, its file endings, what marks a function and a type in a line.
LANGUAGES = [
    ("python", "py pyi", r"^\s*(?:async\s+)?def\s+([A-Za-z_]\w*)", r"^\s*class\s+([A-Za-z_]\w*)"),
    ("go", "go", r"^func\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)", r"^type\s+([A-Za-z_]\w*)\s+(?:struct|interface)"),
    ("rust", "rs", r"^\s*(?:pub\s+)?(?:async\s+)?fn\s+([A-Za-z_]\w*)", r"^\s*(?:pub\s+)?(?:struct|enum|trait)\s+([A-Za-z_]\w*)"),
    ("javascript", "js jsx mjs", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)", r"^\s*(?:export\s+)?class\s+([A-Za-z_]\w*)"),
    ("typescript", "ts tsx", r"^\s*(?:export\s+)?(?:async\s+)?function\s+([A-Za-z_]\w*)", r"^\s*(?:export\s+)?(?:class|interface)\s+([A-Za-z_]\w*)"),
    ("java", "java", r"^\s*(?:(?:public|private|protected|static|final)\s+)+[\w<>\[\],]+\s+([A-Za-z_]\w*)\s*\(", r"^\s*(?:(?:public|private|protected|static|final|abstract)\s+)*(?:class|interface|enum)\s+([A-Za-z_]\w*)"),
    ("kotlin", "kt kts", r"^\s*(?:\w+\s+)*fun\s+([A-Za-z_]\w*)", r"^\s*(?:\w+\s+)*(?:class|object)\s+([A-Za-z_]\w*)"),
    ("ruby", "rb", r"^\s*def\s+([A-Za-z_]\w*)", r"^\s*(?:class|module)\s+([A-Za-z_]\w*)"),
    ("shell", "sh bash", r"^\s*(?:function\s+)?([A-Za-z_]\w*)\s*\(\)", ""),
    ("lua", "lua", r"^\s*(?:local\s+)?function\s+([A-Za-z_][\w.:]*)", ""),
]
# Folders that a walk leaves out.
IGNORED = [".git", "node_modules", "vendor", "__pycache__", "target", "build", "dist"]
MAX_BYTES = 2 << 20
#: Symbols of a file that leave a task in one batch.
SYMBOLS_AT_ONCE = 1000
#: Kind of the row that tells of a file without a syntax tree.
UNPARSED = "Unparsed"
SYMBOLS = "path string, kind string, name string, qualified_name string, line_start int, line_end int, calls array<string>, bases array<string>"


def language(path: Column) -> Column:
    """The language of a path by its ending; null for none."""
    ending = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.coalesce(*[F.when(ending.isin(ends.split()), F.lit(name)) for name, ends, _, _ in LANGUAGES])


def read_sources(spark: SparkSession, root: str) -> DataFrame:
    """(path, language, content, sha256) of the known source files under root of at most MAX_BYTES. Spark's reader passes over files of 0 bytes."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    files = files.where((F.col("length") <= MAX_BYTES) & ~F.col("path").rlike("/(" + "|".join(x.replace(".", r"\.") for x in IGNORED) + ")/"))
    return files.select("path", language(F.col("path")).alias("language"), F.decode("content", "UTF-8").alias("content"), F.sha2("content", 256).alias("sha256")).where("language IS NOT NULL")


def _base(base: ast.expr) -> str:
    try:
        return ast.unparse(base)
    except RecursionError:  # too deep to be written out, so its kind stands for it
        return f"<{type(base).__name__}>"


def _of_tree(path: str, tree: ast.AST) -> Iterator[tuple]:
    todo: list[tuple[ast.AST, str]] = [(tree, "")]
    while todo:
        node, owner = todo.pop()
        for child in ast.iter_child_nodes(node):
            inner = owner
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                inner = f"{owner}.{child.name}" if owner else child.name
                is_type = isinstance(child, ast.ClassDef)
                called = [] if is_type else sorted({f.id if isinstance(f, ast.Name) else f.attr for c in ast.walk(child) if isinstance(c, ast.Call) and isinstance(f := c.func, (ast.Name, ast.Attribute))})
                bases = [_base(b) for b in child.bases] if is_type else []
                yield path, "Class" if is_type else "Function", child.name, inner, child.lineno, child.end_lineno, called, bases
            todo.append((child, inner))


def _python(batches: Iterator[pa.RecordBatch], failures: bool = False) -> Iterator[pa.RecordBatch]:
    names = [part.split()[0] for part in SYMBOLS.split(", ")]
    kinds = [*[pa.string()] * 4, pa.int32(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.string())]
    for batch in pieces(batches):
        # one tree at a time, and its symbols leave before the next
        for path, text in zip(*batch.columns, strict=True):
            try:
                rows = list(_of_tree(path.as_py(), ast.parse(text.as_py() or "")))
            except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
                line = getattr(e, "lineno", None)
                why = getattr(e, "msg", None) or str(e)
                rows = [(path.as_py(), UNPARSED, f"{type(e).__name__}: {why}", None, line, line, None, None)] if failures else []
            for i in range(0, len(rows), SYMBOLS_AT_ONCE):
                columns = zip(*rows[i : i + SYMBOLS_AT_ONCE], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def python_symbols(files: DataFrame, failures: bool = False) -> DataFrame:
    """SYMBOLS of the Python files in files(path, content), by their syntax tree.

    With failures a file that cannot be read is a row of the kind UNPARSED with the error as its name, its line, and
    null calls; else such files are left out, like those without symbols.
    """
    return files.select("path", "content").mapInArrow(partial(_python, failures=failures), SYMBOLS)


def line_symbols(files: DataFrame) -> DataFrame:
    """(path, kind, name, line_start) of files(path, language, content), by the patterns of their language."""
    lines = files.select("path", "language", F.posexplode(F.split("content", "\n")).alias("i", "line"))

    def name(at: int) -> Column:
        return F.coalesce(*[F.when((F.col("language") == x[0]) & F.col("line").rlike(x[at]), F.regexp_extract("line", x[at], 1)) for x in LANGUAGES if x[at]])

    both = lines.select("path", F.coalesce(F.when(name(2).isNotNull(), F.struct(F.lit("Function").alias("kind"), name(2).alias("name"))), F.when(name(3).isNotNull(), F.struct(F.lit("Class").alias("kind"), name(3).alias("name")))).alias("s"), (F.col("i") + 1).alias("line_start"))
    return both.where("s IS NOT NULL").select("path", "s.kind", "s.name", "line_start")


def sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, level, heading, content, line_start): Markdown by its # headings. What stands before the first is level 0, if not empty."""
    cut = docs.select(F.col(id_col), F.split(F.coalesce(F.col(text_col), F.lit("")), r"(?m)^(?=#{1,6} )").alias("s"))
    count = F.transform("s", lambda x: F.length(x) - F.length(F.replace(x, F.lit("\n"), F.lit(""))))
    first = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("seen"))
    starts = F.aggregate(count, first, lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["seen"], F.array(a["at"])).alias("seen")), lambda a: a["seen"])
    rows = cut.select(id_col, F.posexplode(F.arrays_zip("s", starts.alias("at"))).alias("section", "x")).select(id_col, "section", F.col("x.s").alias("s"), F.col("x.at").alias("line_start"))
    head = "^(#{1,6}) ([^\n]*)(?:\n|$)"
    return rows.where("s <> ''").select(id_col, F.col("section"), F.length(F.regexp_extract("s", head, 1)).alias("level"), F.regexp_extract("s", head, 2).alias("heading"), F.rtrim(F.regexp_replace("s", head, ""), F.lit("\n")).alias("content"), "line_start")


def read_table(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """A CSV or TSV table with a header; every cell is a string, missing ones are ''."""
    df = spark.read.csv(path, header=True, sep=sep, ignoreLeadingWhiteSpace=True, mode="PERMISSIVE", escape='"', multiLine=False)
    return df.na.fill("")


BINARY = "binary_id string, functions array<struct<address: string, name: string, calls: array<string>, basic_blocks: array<struct<address: string, instructions: array<struct<address: string, mnemonic: string, operands: string>>>>>>"


def read_binaries(spark: SparkSession, path: str) -> DataFrame:
    """Binaries as nested records from lines of JSON."""
    return spark.read.schema(BINARY).json(path)


def instructions(binaries: DataFrame) -> DataFrame:
    """(binary_id, function, block, address, mnemonic, operands): a row for each instruction."""
    f = binaries.select("binary_id", F.explode("functions").alias("f"))
    b = f.select("binary_id", F.col("f.address").alias("function"), F.explode("f.basic_blocks").alias("b"))
    return b.select("binary_id", "function", F.col("b.address").alias("block"), F.explode("b.instructions").alias("i")).select("binary_id", "function", "block", "i.*")


def binary_calls(binaries: DataFrame) -> DataFrame:
    """(binary_id, from_function, to_function): each call once."""
    f = binaries.select("binary_id", F.explode("functions").alias("f"))
    return f.select("binary_id", F.col("f.address").alias("from_function"), F.explode("f.calls").alias("to_function")).distinct()


def numstat(lines: DataFrame, column: str = "value") -> DataFrame:
    """(added, deleted, path) of lines of a change log with numbers; '-' of binary files counts as 0."""
    form = r"^([0-9]+|-)\t([0-9]+|-)\t(.+)$"
    n = [F.coalesce(F.expr(f"try_cast(regexp_extract({column}, r'{form}', {i}) AS BIGINT)"), F.lit(0)) for i in (1, 2)]
    return lines.where(F.col(column).rlike(form)).select(n[0].alias("added"), n[1].alias("deleted"), F.regexp_extract(column, form, 3).alias("path"))
