"""Output of processes: lines put together to records, records parsed by eight ordered rules.

A line is judged by the first rule that fits it; of each field the last line that gives one counts, frames of a stack add
up. Everything is column functions over the lines of a text, so no shuffle and no Python is needed to parse.

assemble() cuts the lines of a process into records, over a table with window functions; assemble_stream() does the same
over a stream, with the open record of each process as state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

# The rules in the order in which a line is held against them.
RULES = [
    ("file_line", r"^([a-zA-Z0-9_\-\\/.]+):(\d+)(?::(\d+))?:"),
    ("address", r"^(0x[0-9a-fA-F]+)\s*(?:<([^+>]+)(?:\+0x([0-9a-fA-F]+))?>)?"),
    ("stack_frame", r"^#(\d+)\s+([^\s\(]+)(?:\s+\(([^\)]+)\))?"),
    ("exception", r"(?i)(?:exception|error|fault|panic|abort):\s*([^\s]+)"),
    ("error_code", r"(?i)(?:error|errno|code)[:\s=]+([0-9a-fA-FxX\-]+)"),
    ("test_failure", r"(?i)FAIL\s+(?:---\s+)?([a-zA-Z0-9_\./]+)"),
    ("symbol_offset", r"^([a-zA-Z0-9_\.]+)\s*\+\s*(0x[0-9a-fA-F]+|0\d+)"),
    ("module_offset", r"^([^\s!]+)!([0-9a-fA-FxX]+)"),
]
# Words of each severity and event type, in the order in which they are looked for.
SEVERITIES = [("P0", ["panic", "fatal", "crash", "segfault", "segmentation fault", "assertion failed", "abort"]), ("P1", ["error", "exception", "fail", "invalid"]), ("P2", ["warning", "warn", "unexpected"])]
EVENT_TYPES = [("crash", ["panic", "fatal", "crash", "segfault", "segmentation fault", "abort"]), ("exception", ["exception"]), ("assertion", ["assertion"]), ("test_failure", ["test", "fail"]), ("linker_diagnostic", ["linker", "ld:"])]
#: Fields: the rule and group that give each, later lines and, on one line, later entries first.
FIELDS = {
    "file": [("file_line", 1)],
    "line": [("file_line", 2)],
    "column": [("file_line", 3)],
    "address": [("address", 1), ("module_offset", 2)],
    "symbol": [("address", 2), ("symbol_offset", 1)],
    "offset": [("address", 3), ("symbol_offset", 2)],
    "exception": [("exception", 1)],
    "error_code": [("error_code", 1)],
    "test_name": [("test_failure", 1)],
    "module": [("module_offset", 1)],
}
#: Rules whose lines are left out of the message.
SILENT = ["stack_frame", "error_code"]
#: Seconds without output after which a record is closed, and the most lines of one.
IDLE, LONGEST = 30, 1000
_PATTERN = dict(RULES)


def cleaned(text: Column) -> Column:
    """The text without terminal colours and without blanks at its ends."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "\\x1b[^m]*(m|$)", ""))


def _rule(line: Column) -> Column:
    out = F.lit("")
    for name, pattern in reversed(RULES):
        out = F.when(F.regexp_like(line, F.lit(pattern)), F.lit(name)).otherwise(out)
    return out


def _given(x: Column, field: str) -> Column:
    """What a line (struct of line and rule) gives a field, empty if nothing."""
    out = F.lit("")
    for rule, group in FIELDS[field]:
        value = F.regexp_extract(x["line"], _PATTERN[rule], group)
        if field == "offset" and rule == "address":
            value = F.when(value != "", F.concat(F.lit("0x"), value)).otherwise("")
        out = F.when(x["rule"] == rule, value).otherwise(out)
    return out


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def parse(records: DataFrame, text_col: str = "text") -> DataFrame:
    """records plus file, line, column, address, symbol, offset, exception, error_code, test_name, module, stack, message, severity, event_type.

    Fields that no line gives are empty, line and column 0. A null text is empty; columns of these names are replaced.
    """
    lines = F.filter(F.transform(F.split(cleaned(F.col(text_col)), "\n"), lambda s: F.trim(F.regexp_replace(s, r"^\s+|\s+$", ""))), lambda s: s != "")
    x = records.withColumn("__lines", F.transform(lines, lambda s: F.struct(s.alias("line"), _rule(s).alias("rule"))))
    last = lambda f: F.coalesce(F.try_element_at(F.filter(F.transform("__lines", lambda y: _given(y, f)), lambda v: v != ""), F.lit(-1)), F.lit(""))
    number = lambda v: F.coalesce(v.try_cast("bigint"), F.lit(0))
    x = x.withColumns({f: last(f) for f in FIELDS})
    x = x.withColumns({"line": number(F.col("line")), "column": number(F.col("column"))})
    x = x.withColumn("stack", F.transform(F.filter("__lines", lambda y: y["rule"] == "stack_frame"), lambda y: F.regexp_extract(y["line"], _PATTERN["stack_frame"], 2)))
    x = x.withColumn("message", F.array_join(F.transform(F.filter("__lines", lambda y: ~y["rule"].isin(SILENT)), lambda y: y["line"]), " | "))
    low = F.lower("message")
    severity, kind = F.lit("P3"), F.when((F.col("file") != "") & low.contains("error"), "compiler_diagnostic").otherwise("info")
    for name, words in reversed(SEVERITIES):
        severity = F.when(_any(low, words), name).otherwise(severity)
    for name, words in reversed(EVENT_TYPES):
        kind = F.when(_any(low, words), name).otherwise(kind)
    return x.withColumns({"severity": severity, "event_type": kind}).drop("__lines")


def assemble(lines: DataFrame, idle: int = IDLE, longest: int = LONGEST) -> DataFrame:
    """(process, first_seq, n_lines, text) of lines(process, seq, ts, line): a record ends at an empty line, after `idle` seconds without one, and at `longest` lines.

    Lines are in order of seq within their process; null lines are empty, rows without process, seq or ts are left out.
    """
    own = lines.where("process IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").select("process", "seq", "ts", F.coalesce("line", F.lit("")).alias("line"))
    by = Window.partitionBy("process").orderBy("seq")
    late = F.col("ts").cast("double") - F.lag(F.col("ts").cast("double")).over(by) > idle
    x = own.withColumn("fresh", (F.coalesce(late, F.lit(True)) | (F.lag("line").over(by) == "")).cast("int"))
    x = x.withColumn("island", F.sum("fresh").over(by)).where("line <> ''")
    x = x.withColumn("part", F.floor((F.row_number().over(Window.partitionBy("process", "island").orderBy("seq")) - 1) / longest))
    rows = x.groupBy("process", "island", "part").agg(F.min("seq").alias("first_seq"), F.count("*").alias("n_lines"), F.array_sort(F.collect_list(F.struct("seq", "line"))).alias("lines"))
    return rows.select("process", "first_seq", "n_lines", F.array_join(F.col("lines.line"), "\n").alias("text"))


def assemble_stream(lines: DataFrame, idle: int = IDLE, longest: int = LONGEST, delay: str = "10 seconds") -> DataFrame:
    """assemble() over a stream. The state of a process is its open record, at most `longest` lines; a timer closes it when event time has passed it by `idle` seconds, and the state goes."""

    def run(key: tuple, chunks: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out: list[tuple] = []
        first, last, held = state.get if state.exists else (0, 0.0, "")
        open_lines = held.split("\n") if held else []

        def close() -> None:
            if open_lines:
                out.append((key[0], first, len(open_lines), "\n".join(open_lines)))
                open_lines.clear()

        if state.hasTimedOut:
            close()
        else:
            for seq, ts, line in sorted((r.seq, r.ts.timestamp(), r.line or "") for chunk in chunks for r in chunk.itertuples()):
                if open_lines and (ts - last > idle or len(open_lines) >= longest):
                    close()
                last = ts
                if line == "":
                    close()
                    continue
                if not open_lines:
                    first = seq
                open_lines.append(line)
        if open_lines:
            state.update((int(first), float(last), "\n".join(open_lines)))
            # a timer may not lie before the watermark
            state.setTimeoutTimestamp(max(int((last + idle) * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["process", "first_seq", "n_lines", "text"])

    own = lines.where("process IS NOT NULL AND seq IS NOT NULL AND ts IS NOT NULL").select("process", "seq", "ts", F.coalesce("line", F.lit("")).alias("line"))
    return own.withWatermark("ts", delay).groupBy("process").applyInPandasWithState(run, "process string, first_seq long, n_lines long, text string", "first long, last double, held string", "append", GroupStateTimeout.EventTimeTimeout)
