"""What an import means: files of the project by the path rules of its language; imports nothing uses; files that a machine wrote.

Each import gives a few candidate keys in steps: an exact path, the end of a path that one file alone may have, or a folder of a
Go package. Files give the same keys, the ends of their paths counted first, so all is found by equality joins, without a
comparison of every import with every path. The first step that finds anything decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselode.operators.graph import union_all
from tesselode.sources.tables import settle

# Endings of scripts in the order they are tried, endings that an import may name for them, those of C, files of a Go package.
SCRIPTS = ["ts", "tsx", "js", "jsx", "mjs", "cjs"]
NAMED = ["js", "jsx", "mjs", "cjs"]
C_ENDINGS = ["c", "h", "cc", "cpp", "hpp"]
PACKAGE_FILES, CONFIDENCE = 20, 0.9
# What marks a file as written by a machine, in its first lines and bytes, or by its name.
HEAD_LINES, HEAD_BYTES = 20, 2048
GENERATED = r"(?i)(code generated\b.*\bdo not edit|@generated\b|auto-?generated|automatically generated|generated by (?:the )?(?:protoc|protobuf|thrift|swagger|openapi|bindgen|cython|antlr|yacc|bison|flex|grpc|mockgen|stringer|sqlc)|do not edit (?:this file )?(?:manually|by hand))"
GENERATED_NAME = r"(?i)(\.pb\.go|\.pb\.cc|\.pb\.h|_pb2(?:_grpc)?\.pyi?|\.min\.js|\.bundle\.js|_generated\.\w+|\.generated\.\w+|\.gen\.go|_gen\.go|_mock\.go)$"
#: Lines that import, by the endings of their language; the first group is the target.
LINES = [
    (["py", "pyi"], [r"(?m)^[ \t]*from[ \t]+([\w.]+)[ \t]+import\b", r"(?m)^[ \t]*import[ \t]+([\w.]+)"]),
    (SCRIPTS, [r"""(?m)\bfrom[ \t]*["']([^"'\n]+)["']""", r"""(?m)^[ \t]*import[ \t]*["']([^"'\n]+)["']""", r"""\brequire\([ \t]*["']([^"'\n]+)["']"""]),
    (["java"], [r"(?m)^[ \t]*import[ \t]+(?:static[ \t]+)?([\w.*]+)[ \t]*;"]),
    (["go"], [r"""(?m)^[ \t]*(?:import[ \t]+)?(?:[\w.]+[ \t]+)?"([^"\n]+)"[ \t]*$"""]),
    (C_ENDINGS, [r"""(?m)^[ \t]*#[ \t]*include[ \t]*[<"]([^>"\n]+)"""]),
    (["rs"], [r"(?m)^[ \t]*(?:pub[ \t]+)?mod[ \t]+(\w+)[ \t]*;"]),
]
SALTS = 32


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]*)$", 1))


def _parts(path: Column) -> Column:
    """The steps of a path, with . gone and .. taken back where it can be."""
    absolute, none = path.startswith("/"), F.array().cast("array<string>")

    def step(acc: Column, p: Column) -> Column:
        back = F.when((F.size(acc) > 0) & (F.element_at(acc, -1) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).when(absolute, acc).otherwise(F.array_append(acc, p))
        return F.when(p.isin("", "."), acc).when(p == "..", back).otherwise(F.array_append(acc, p))

    return F.aggregate(F.split(path, "/"), none, lambda a, p: step(a, p))


def cleaned(path: Column) -> Column:
    text = F.concat(F.when(path.startswith("/"), "/").otherwise(""), F.array_join(_parts(path), "/"))
    return F.when(text == "", ".").otherwise(text)


def _folder(path: Column) -> Column:
    cut = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(~path.contains("/"), ".").when(cut == "", "/").otherwise(cut)


def _under(folder: Column, *rest: Column | str) -> Column:
    return cleaned(F.concat(folder, F.lit("/"), *[F.lit(r) if isinstance(r, str) else r for r in rest]))


def candidates(imports: DataFrame, go_module: str | None = None, root: str = ".") -> DataFrame:
    """(path, target, step, how, key) of imports(path, target): what may be meant, the lowest step first."""
    x = imports.where("path IS NOT NULL AND target IS NOT NULL").select("path", "target").distinct()
    path, target = F.col("path"), F.col("target")
    base = _under(_folder(path), target)
    for e in NAMED:
        base = F.regexp_replace(base, rf"\.{e}$", "")
    # columns of their own, as a script's twelve candidates share them
    x = x.withColumn("_folder", _folder(path)).withColumn("_ext", ending(path))
    x = x.withColumn("_base", F.when(F.col("_ext").isin(SCRIPTS) & target.startswith("."), base)).withColumn("_index", cleaned(F.concat("_base", F.lit("/index"))))
    folder, ext, base, index = (F.col(c) for c in ("_folder", "_ext", "_base", "_index"))

    def keys(*found: tuple[int, str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(s).alias("step"), F.lit(how).alias("how"), key.alias("key")) for s, how, key in found])

    none = F.array().cast("array<struct<step:int,how:string,key:string>>")
    # Python: each dot beyond the first goes a folder up
    rel = F.regexp_replace(target, r"^\.+", "")
    up = F.length(target) - F.length(rel) - 1
    steps = _parts(folder)
    top = F.concat(F.when(folder.startswith("/"), "/").otherwise("./"), F.array_join(F.slice(steps, 1, F.greatest(F.size(steps) - up, F.lit(0))), "/"))
    slashed = F.replace(rel, F.lit("."), F.lit("/"))
    python = F.when(target.startswith("."), F.when(rel == "", keys((0, "exact", _under(top, "__init__.py")))).otherwise(keys((0, "exact", _under(top, slashed, ".py")), (0, "exact", _under(top, slashed, "/__init__.py")))))
    python = python.otherwise(keys((0, "end", F.concat(slashed, F.lit(".py"))), (1, "end", F.concat(slashed, F.lit("/__init__.py")))))
    tries = [(i, "exact", F.concat(base, F.lit(f".{e}"))) for i, e in enumerate(SCRIPTS)]
    tries += [(len(SCRIPTS) + i, "exact", F.concat(index, F.lit(f".{e}"))) for i, e in enumerate(SCRIPTS)]
    script = F.when(target.startswith("."), keys(*tries)).otherwise(none)
    java = F.when(target.endswith(".") | target.endswith("*"), none).otherwise(keys((0, "end", F.concat(F.replace(target, F.lit("."), F.lit("/")), F.lit(".java")))))
    segments = F.split(target, "/")
    go = keys((0, "tail", F.array_join(F.slice(segments, F.greatest(F.size(segments) - 1, F.lit(1)), 2), "/")))
    if go_module:
        inside = (target == go_module) | target.startswith(go_module + "/")
        go = F.when(inside, keys((0, "folder", _under(F.lit(root), F.substring(target, len(go_module) + 1, 1 << 20))))).otherwise(go)
    c = keys((0, "exact", _under(folder, target)), (1, "end", target))
    rust = keys((0, "exact", _under(folder, target, ".rs")), (0, "exact", _under(folder, target, "/mod.rs")))
    rule = F.when(ext == "py", python).when(ext.isin(SCRIPTS), script).when(ext == "java", java).when(ext == "go", go).when(ext.isin(C_ENDINGS), c).when(ext == "rs", rust)
    return x.select("path", "target", F.explode(rule).alias("k")).select("path", "target", "k.*")


def _answers(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(how, key, hit): what each wanted key finds among files(path); at most PACKAGE_FILES a key."""
    paths = files.where("path IS NOT NULL").select("path").distinct()
    exact = paths.select(F.lit("exact").alias("how"), F.col("path").alias("key"), F.col("path").alias("hit"))
    parts = F.split("path", "/")
    ends = paths.where(F.size(parts) > 1).select("path", F.explode(F.transform(F.sequence(F.lit(2), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("key"))
    asked = wanted.where("how = 'end'").select("key").distinct()
    ends = ends.join(asked, "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"), F.min("path").alias("hit")).where("n = 1")
    ends = ends.select(F.lit("end").alias("how"), "key", "hit")
    go = paths.where("path LIKE '%.go' AND path NOT LIKE '%\\_test.go'").withColumn("folder", _folder(F.col("path")))
    steps = F.split("folder", "/")
    tails = F.filter(F.array(*[F.when(F.size(steps) > n, F.array_join(F.slice(steps, F.greatest(F.size(steps) - n + 1, F.lit(1)), n), "/")) for n in (1, 2)]), lambda t: t.isNotNull())
    named = [go.select(F.lit("folder").alias("how"), F.col("folder").alias("key"), F.col("path").alias("hit")), go.select(F.lit("tail").alias("how"), F.explode(tails).alias("key"), F.col("path").alias("hit"))]
    package = union_all(named).withColumn("salt", F.pmod(F.xxhash64("hit"), F.lit(SALTS)))
    for own in (["how", "key", "salt"], ["how", "key"]):
        package = package.withColumn("nth", F.row_number().over(Window.partitionBy(*own).orderBy("hit"))).where(F.col("nth") <= PACKAGE_FILES)
    return union_all([exact, ends, package.select("how", "key", "hit")])


def resolved(imports: DataFrame, files: DataFrame, go_module: str | None = None, root: str = ".") -> DataFrame:
    """(from_path, to_path, confidence): the files of files(path) that imports(path, target) mean, each pair once, none of a file with itself.

    The importing path's ending tells the language: Python, scripts, Java, Go, C and Rust. The end of a path counts only if one file
    has it; a Go package has its first PACKAGE_FILES files by path, without tests. External targets, wildcards, nulls and unknown endings find nothing.
    """
    asked = settle(candidates(imports, go_module, root))  # read for the keys that are asked for and for the join
    hits = asked.join(_answers(files, asked), ["how", "key"])
    first = F.min("step").over(Window.partitionBy("path", "target"))
    hits = hits.withColumn("first", first).where("step = first AND hit <> path")
    return hits.select(F.col("path").alias("from_path"), F.col("hit").alias("to_path")).distinct().withColumn("confidence", F.lit(CONFIDENCE))


def imports_of(files: DataFrame) -> DataFrame:
    """(path, target) of the lines of files(path, content) that import, each once. Null contents hold none."""
    ext, text = ending(F.col("path")), F.coalesce("content", F.lit(""))
    rule = F.array().cast("array<string>")
    for endings, patterns in reversed(LINES):
        rule = F.when(ext.isin(endings), F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])).otherwise(rule)
    return files.select("path", F.explode(F.array_distinct(rule)).alias("target"))


def dead_imports(files: DataFrame, imports: DataFrame) -> DataFrame:
    """(source, module) of imports(path, target) whose last name stands once or never, as a word, in the content of files(path, content).

    The last name is what follows the last dot, then the last slash; an empty one is left out. Null contents count as empty.
    """
    named = imports.where("target IS NOT NULL").select("path", F.col("target").alias("module")).distinct()
    last = F.element_at(F.split(F.element_at(F.split("module", r"\."), -1), "/"), -1)
    own = named.withColumn("short", last).where("short <> ''").groupBy("path").agg(F.collect_list(F.struct("module", "short")).alias("own"))
    x = files.select("path", F.coalesce("content", F.lit("")).alias("content")).join(own, "path")
    inner, outer = "[0-9A-Za-z_]", "[^0-9A-Za-z_]"

    def pattern(short: Column) -> Column:
        quoted = F.concat(F.lit("\\Q"), F.replace(short, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
        # a boundary lies between a word character and another, so which look-around is right depends on the name's ends
        before = F.when(short.rlike(f"^{inner}"), f"(?<!{inner})").otherwise(f"(?<={inner})")
        after = F.when(short.rlike(f"{inner}$"), f"(?!{inner})").otherwise(f"(?={inner})")
        return F.concat(before, quoted, after)

    dead = F.filter("own", lambda m: F.regexp_count(F.col("content"), pattern(m["short"])) <= 1)
    return x.select(F.col("path").alias("source"), F.explode(F.transform(dead, lambda m: m["module"])).alias("module")).distinct()


def generated(path: Column, content: Column) -> Column:
    """Whether a file was written by a machine: by its name, or a mark in its first HEAD_LINES lines and HEAD_BYTES bytes. Null counts as empty."""
    lines = F.substring_index(F.coalesce(content, F.lit("")), "\n", HEAD_LINES)
    head = F.substring(lines.cast("binary"), 1, HEAD_BYTES).cast("string")
    return F.coalesce(path.rlike(GENERATED_NAME), F.lit(False)) | head.rlike(GENERATED)
