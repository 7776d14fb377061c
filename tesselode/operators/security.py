"""All security rules over files in one scan, and the reports on what they find.

An automaton of the literals that the rules cannot do without is run once over a text; a rule's pattern is
tried only on texts that hold one of its literals and are of its language, by Arrow's RE2, whose time is linear in the
text whatever the pattern.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselode.functions.security_rules import RULES, WEAKNESSES
from tesselode.sources.tables import pieces

# Endings of files that are scanned, and their languages.
LANGUAGES = {"py": "python", "c": "c", "h": "c", "cc": "c", "cpp": "c", "hpp": "c", "rs": "rust", "go": "go", "js": "javascript", "ts": "javascript", "tsx": "javascript", "java": "java"}
# Folders that are passed over.
SKIPPED = [".git", ".venv", "node_modules", "target", "build", "vendor", "dist"]
# Lines and characters of a snippet, findings at the top of a report.
SNIPPET_LINES, SNIPPET_CHARS, TOP = 3, 200, 20
#: Shorter literals are looked for one by one: the automaton would stop at each of them.
_SHORT = 3


def literals(pattern: str) -> frozenset[str] | None:
    """Lower-case texts of which every match holds at least one; None if there are none to name. Of several choices the longest."""
    parser = re._parser  # the standard library's own reading of a pattern

    def better(a: frozenset[str] | None, b: frozenset[str] | None) -> frozenset[str] | None:
        if a is None or b is None:
            return a if b is None else b
        return max(a, b, key=lambda s: (min(map(len, s)), -len(s)))

    def of(items) -> frozenset[str] | None:
        best, run = None, ""
        for op, value in [*items, (None, None)]:
            name = str(op)
            if name == "LITERAL":
                run += chr(value)
                continue
            if run:
                best, run = better(best, frozenset([run.lower()])), ""
            if name == "SUBPATTERN":
                best = better(best, of(value[-1]))
            elif name == "MAX_REPEAT" and value[0] > 0:
                best = better(best, of(value[2]))
            elif name == "BRANCH":
                arms = [of(arm) for arm in value[1]]
                if all(arms):
                    best = better(best, frozenset().union(*arms))
        return best

    return of(parser.parse(pattern))


class Matcher:
    """The rules made ready for a task."""

    def __init__(self, rules: list[tuple]) -> None:
        self.rules, self.needs, self.always, self.short = rules, {}, [], {}
        self.automaton = ahocorasick.Automaton()
        for i, rule in enumerate(rules):
            needed = literals(rule[3])
            if needed is None:
                self.always.append(i)
            for text in needed or ():
                (self.short if len(text) < _SHORT else self.needs).setdefault(text, []).append(i)
        for text, numbers in self.needs.items():
            self.automaton.add_word(text, numbers)
        if self.needs:
            self.automaton.make_automaton()

    def possible(self, text: str) -> set[int]:
        """Rules whose literals the text holds. The long s, which a pattern without case takes for an s, counts as one."""
        low = text.lower().replace("ſ", "s")
        out = set(self.always)
        for word, numbers in self.short.items():
            if word in low:
                out.update(numbers)
        if self.needs:
            for _, numbers in self.automaton.iter(low):
                out.update(numbers)
        return out

    def matches(self, texts: list[str], languages: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """(text, rule, byte where the first match begins)."""
        wanted: dict[int, list[int]] = {}
        for i, (text, language) in enumerate(zip(texts, languages, strict=True)):
            for r in self.possible(text):
                if self.rules[r][1] in ("all", language):
                    wanted.setdefault(r, []).append(i)
        for r, at in sorted(wanted.items()):
            found = pc.find_substring_regex(pa.array([texts[i] for i in at], pa.large_string()), self.rules[r][3])
            for i, byte in zip(at, found.to_pylist(), strict=True):
                if byte >= 0:
                    yield i, r, byte


def file_language(path):
    """The language of a path by its ending, null for files that are not scanned."""
    ending = F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))
    folders = F.slice(F.split(path, "/"), 1, F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    pairs = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.when(~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in SKIPPED])), pairs[ending])


_OUT = "path string, language string, rule int, cwe string, name string, confidence double, line int, snippet string"


def findings(files: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """path, language, rule, cwe, name, confidence, line, snippet: the first match of each rule in each of files(path, language, content).

    Null contents hold nothing; a null language is that of the rules for all alone; repeated rows are looked at each. rule is
    the rule's number; a snippet is the match's line and the two after it, at most SNIPPET_CHARS characters.
    """
    rules = RULES if rules is None else rules

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(rules)
        for batch in pieces(batches):
            paths, languages, texts = (c.to_pylist() for c in batch.columns)
            texts, rows = [t or "" for t in texts], []
            for i, r, byte in own.matches(texts, languages):
                cwe, _, name, _, confidence = rules[r]
                raw = texts[i].encode()
                line = raw.count(b"\n", 0, byte)
                begin = raw.rfind(b"\n", 0, byte) + 1
                few = raw[begin:].split(b"\n", SNIPPET_LINES)[:SNIPPET_LINES]
                rows.append((paths[i], languages[i], r, cwe, name, confidence, line + 1, b"\n".join(few).decode()[:SNIPPET_CHARS]))
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.string()]
            cols = list(zip(*rows, strict=True)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in _OUT.split(", ")])

    return files.select("path", "language", "content").mapInArrow(run, _OUT)


def weaknesses(spark: SparkSession) -> DataFrame:
    """(cwe, title, description, severity, rules): the table with the number of rules of each."""
    n: dict[str, int] = {}
    for rule in RULES:
        n[rule[0]] = n.get(rule[0], 0) + 1
    return spark.createDataFrame([(*w, n.get(w[0], 0)) for w in WEAKNESSES], "cwe string, title string, description string, severity string, rules int")


def graded(found: DataFrame) -> DataFrame:
    """Findings with the severity of their weakness; null for one that the table lacks."""
    return found.join(F.broadcast(weaknesses(found.sparkSession).select("cwe", "severity")), "cwe", "left")


def select_findings(found: DataFrame, cwe: str | None = None, severity: str | None = None, least: float = 0.0, limit: int | None = None) -> DataFrame:
    """Graded findings of a weakness, a severity, a confidence and up; the surest first, then by path, line and rule."""
    out = graded(found).where(F.col("confidence") >= least)
    if cwe:
        out = out.where(F.col("cwe") == cwe)
    if severity:
        out = out.where(F.col("severity") == severity)
    out = out.orderBy(F.desc("confidence"), "path", "line", "rule")
    return out if limit is None else out.limit(limit)


def metrics(found: DataFrame) -> DataFrame:
    """(what, key, n): findings in all, by weakness, by severity (each of the three, were it 0), by language."""
    own = graded(found)
    levels = found.sparkSession.createDataFrame([("HIGH",), ("MEDIUM",), ("LOW",)], "severity string")
    counts = own.groupBy("cwe", "severity", "language").agg(F.count("*").alias("n"))  # a few rows
    part = lambda what, key: counts.groupBy(F.col(key).alias("key")).agg(F.sum("n").alias("n")).select(F.lit(what).alias("what"), "key", "n")
    by_level = levels.join(part("severity", "severity").withColumnRenamed("key", "severity"), "severity", "left").select(F.lit("severity").alias("what"), F.col("severity").alias("key"), F.coalesce("n", F.lit(0)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("total").alias("what"), F.lit("").alias("key"), "n")
    return total.unionByName(part("cwe", "cwe")).unionByName(by_level).unionByName(part("language", "language"))
