"""What may leave a project: names under numbered tokens, texts with their names replaced, and the ladder that blocks or cleans a text.

Names are numbered without a window over a whole kind: rows are put in order by ranges, counted by range and kind, and
numbered inside their range from where the ranges before it end. A text's names are replaced the longest first, all
at once: an automaton lists the matches, and a match stands if no longer one (of equal length: no smaller name, no earlier
start) covers any of it. Names are looked for in blocks of bounded bytes, the longest first, so that the automaton of a task is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesselode.functions.text_rules import redact, secret_kinds
from tesselode.sources.tables import pieces, settle

# Mode, what it discloses, the risk that a source is rebuilt from it.
MODES = [("FULL", "UNRESTRICTED", "HIGH"), ("MINIMAL", "SEMANTIC", "MEDIUM"), ("MASKED", "PSEUDONYMIZED", "MEDIUM"), ("STRUCTURAL", "GENERIC", "LOW"), ("ABSTRACT", "PSEUDONYMIZED", "MEDIUM"), ("LOCAL_ONLY", "NONE", "LOW")]
# Modes that replace names, and the pattern of a path that is not allowed.
MASKING = ["MASKED", "ABSTRACT"]
PATHS = r"""(?i)/(home|users|root|etc|var|tmp|opt|srv|usr|root)/[^\t\n\f\r "']*"""
#: Bytes of names and tokens that a task holds at once.
BLOCK_BYTES = 32 << 20
_BLANKS = "[\\t\\n\\x0B\\f\\r \\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]+"


@dataclass(frozen=True)
class Policy:
    """What a project lets out; 0 stands for no limit. Texts that start with an allowed path keep their paths."""

    mode: str = "FULL"
    forbidden_identifiers: list[str] = field(default_factory=list)
    forbidden_paths: list[str] = field(default_factory=list)
    allowed_paths: list[str] = field(default_factory=list)
    max_source_bytes: int = 0
    max_words: int = 0

    def __post_init__(self) -> None:
        if self.mode not in [m for m, _, _ in MODES]:
            raise ValueError(f"unknown privacy mode: {self.mode}")
        if self.max_source_bytes < 0 or self.max_words < 0:
            raise ValueError("limits must be 0 or more")


def numbered(sightings: DataFrame) -> DataFrame:
    """(name, kind, token) of sightings(name, kind, seen): a name has the kind of its first sighting and that kind's next number.

    Sightings of one time go by kind, names first seen at one time by name. Null and empty names and kinds have no token; repeated rows are one.
    """
    first = sightings.where("name <> '' AND kind <> '' AND seen IS NOT NULL").groupBy("name").agg(F.min(F.struct("seen", "kind")).alias("m"))
    first = first.select("name", "m.kind", "m.seen")
    ranges = settle(first.repartitionByRange("kind", "seen", "name").withColumn("part", F.spark_partition_id()))
    # a row for each range and kind: as many as there are ranges, and the kinds
    ends = ranges.groupBy("kind", "part").agg(F.count("*").alias("n"))
    ends = ends.select("kind", "part", (F.sum("n").over(Window.partitionBy("kind").orderBy("part")) - F.col("n")).alias("before"))
    at = F.row_number().over(Window.partitionBy("kind", "part").orderBy("seen", "name"))
    return ranges.withColumn("at", at).join(F.broadcast(ends), ["kind", "part"]).select("name", "kind", F.concat_ws("_", "kind", (F.col("before") + F.col("at")).cast("string")).alias("token"))


class _Replacer:
    def __init__(self, names: list[tuple[str, str]]) -> None:
        self.automaton = ahocorasick.Automaton()
        for name, token in names:
            self.automaton.add_word(name, (-len(name.encode()), name, token))
        self.automaton.make_automaton()

    def open_piece(self, text: str) -> list[str]:
        """The text cut into pieces that are open (even places) or tokens (odd places)."""
        found = [(*value, end - len(value[1]) + 1) for end, value in self.automaton.iter(text)]
        taken, stands = bytearray(len(text)), []
        for _, name, token, start in sorted(found, key=lambda x: (x[0], x[1], x[3])):
            end = start + len(name)
            if taken.find(1, start, end) < 0:
                taken[start:end] = b"\x01" * (end - start)
                stands.append((start, end, token))
        out, at = [], 0
        for start, end, token in sorted(stands):
            out += [text[at:start], token]
            at = end
        return [*out, text[at:]]

    def pieces(self, before: list[str] | None) -> list[str] | None:
        if before is None:
            return None
        out: list[str] = []
        for i, piece in enumerate(before):
            out += [piece] if i % 2 else self.open_piece(piece)
        return out


def _blocks(tokens: DataFrame, most: int) -> Iterator[list[tuple[str, str]]]:
    """Names with their tokens in blocks of at most `most` bytes, the longest names first, of equal length by name."""
    size = F.octet_length("name")
    own = tokens.where("name <> ''").groupBy("name").agg(F.min("token").alias("token"))
    own = own.select("name", "token", size.alias("size"), (size + F.octet_length("token") + 64).cast("long").alias("cost"))
    total, longest = own.agg(F.sum("cost"), F.max("cost")).first()
    if not total:
        return
    if longest > most:
        raise ValueError(f"a name and its token have more than {most} bytes")
    n = -(-total // most)
    while True:
        cut = settle(own.repartitionByRange(n, F.desc("size"), F.asc("name")).withColumn("part", F.spark_partition_id()))
        costs = dict(cut.groupBy("part").agg(F.sum("cost")).collect())
        if max(costs.values()) <= most:
            break
        n *= 2
    # neighbouring ranges that fit together are one block: there may be more ranges than were asked for
    held: list[int] = []
    for part in [*sorted(costs), None]:
        if held and (part is None or sum(costs[p] for p in held) + costs[part] > most):
            rows = cut.where(F.col("part").isin(held)).select("name", "token").collect()
            yield [(r.name, r.token) for r in rows]
            held = []
        if part is not None:
            held.append(part)


def replaced(texts: DataFrame, tokens: DataFrame, column: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """texts with the names of tokens(name, token) replaced in `column`, the longest first, wherever they stand; a token is never searched again.

    Null texts stay null, empty names replace nothing, of two tokens of one name the smaller stands. Each block of names is one narrow pass over the texts.
    """
    spark, extra = texts.sparkSession, f"_{'_'.join(texts.columns)}"
    out, first = texts.withColumn(extra, F.when(F.col(column).isNotNull(), F.array(column))), True
    for block in _blocks(tokens, block_bytes):
        if not first:
            out = settle(out)  # one automaton a worker, and none built again for a later block
        first, names = False, spark.sparkContext.broadcast(block)

        def task(batches: Iterator[pa.RecordBatch], names=names) -> Iterator[pa.RecordBatch]:
            replacer = None
            for batch in pieces(batches):
                replacer = replacer or _Replacer(names.value)
                at = batch.schema.get_field_index(extra)
                new = pa.array([replacer.pieces(p) for p in batch.column(at).to_pylist()], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([new if i == at else c for i, c in enumerate(batch.columns)], batch.schema.names)

        out = out.mapInArrow(task, out.schema)
    return out.withColumn(column, F.array_join(extra, "")).drop(extra)


def _any(items: list[str], test) -> Column:
    out = F.lit(False)
    for x in items:
        out = out | test(x)
    return out


def _cut_bytes(text: Column, most: int) -> Column:
    """text of at most `most` bytes in UTF-8, with dots if any were cut; a character is never cut in two."""
    raw = text.cast("binary")
    heads = [F.substring(raw, 1, most - k).cast("string") for k in range(min(4, most))]
    head = F.coalesce(*[F.when(F.is_valid_utf8(h), h) for h in heads], F.lit(""))
    return F.when(F.octet_length(text) > most, F.concat(head, F.lit("..."))).otherwise(text)


def sanitized(texts: DataFrame, policy: Policy, tokens: DataFrame | None = None, column: str = "text") -> DataFrame:
    """texts with allowed, sanitized, reasons: what the ladder lets out of `column`, the first rung that applies deciding.

    A local mode, a secret, a forbidden identifier anywhere and a forbidden path at the start block a text. Others lose their
    paths, what is beyond max_source_bytes, in masking modes the names of tokens(name, token), and what is beyond
    max_words. Null texts count as empty; columns of these names are replaced.
    """
    t = F.coalesce(F.col(column), F.lit(""))
    stop = F.when(F.lit(policy.mode == "LOCAL_ONLY"), "local")
    stop = stop.when(secret_kinds(t) != "", "secret").when(_any(policy.forbidden_identifiers, t.contains), "identifier").when(_any(policy.forbidden_paths, t.startswith), "path").otherwise("")
    clean = F.when(_any(policy.allowed_paths, t.startswith), t).otherwise(F.regexp_replace(t, PATHS, "***PATH***"))
    short = _cut_bytes(clean, policy.max_source_bytes) if policy.max_source_bytes else clean
    names = ["allowed", "sanitized", "reasons"]
    out = texts.drop(*[n for n in names if n != column]).withColumn("_stop", stop)
    why = F.array_compact(F.array(F.when(clean != t, "path not allowed"), F.when(short != clean, "max source bytes exceeded")))
    out = out.withColumn("reasons", F.when(F.col("_stop") == "", why)).withColumn("sanitized", F.when(F.col("_stop") == "", short))
    if tokens is not None and policy.mode in MASKING:
        out = replaced(out, tokens, "sanitized")
    x = F.col("sanitized")
    if policy.max_words:
        words = F.filter(F.split(x, _BLANKS), lambda w: w != "")
        long = F.size(words) > policy.max_words
        out = out.withColumn("reasons", F.when(long, F.array_append("reasons", F.lit("max context tokens exceeded"))).otherwise(F.col("reasons")))
        x = F.when(long, F.concat(F.array_join(F.slice(words, 1, policy.max_words), " "), F.lit("..."))).otherwise(x)
    told = {"local": (F.lit("***LOCAL_ONLY***"), "privacy mode is LOCAL_ONLY"), "secret": (redact(t), "secret detected"), "identifier": (F.lit("***FORBIDDEN_IDENTIFIER***"), "forbidden identifier present"), "path": (F.lit("***FORBIDDEN_PATH***"), "forbidden path present")}
    reasons = F.col("reasons")
    for rung, (text, reason) in told.items():
        x = F.when(F.col("_stop") == rung, text).otherwise(x)
        reasons = F.when(F.col("_stop") == rung, F.array(F.lit(reason))).otherwise(reasons)
    return out.select([c for c in texts.columns if c not in names or c == column] + [(F.col("_stop") == "").alias("allowed"), x.alias("sanitized"), reasons.alias("reasons")])
