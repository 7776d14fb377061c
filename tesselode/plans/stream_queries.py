"""Logs of several lines and late rows, as tables and as streams of several micro-batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.operators import logs as L
from tesselode.sources.tables import table
from tesselode.streaming import windows as W

from .catalog import query

SLICES = 6
_N = "CAST({} AS VARCHAR(20))"
#: Each event is a line of its user's process; kinds follow each other so that records have several lines, and every ninth line is empty.
_LINES = [
    f"'src/m' || {_N.format('user_id')} || '.go:' || {_N.format('event_id % 300')} || ':' || {_N.format('event_id % 80')} || ': undefined name error'",
    f"'0x' || {_N.format('40000 + event_id')} || ' <fn' || {_N.format('user_id')} || '+0x1f>'",
    f"'#' || {_N.format('event_id % 9')} || '  frame' || {_N.format('event_id % 31')} || ' (0xbeef)'",
    f"'panic: index' || {_N.format('event_id % 17')} || ' out of range'",
    f"'exit code=' || {_N.format('event_id % 255')}",
    f"'--- FAIL --- pkg/Test' || {_N.format('event_id % 43')}",
    f"'main.run' || {_N.format('event_id % 7')} || ' + 0x4c'",
    f"'libc.so!7ffe' || {_N.format('event_id % 1000')}",
    "'   warning: ' || event_type || '  '",
    "chr(27) || '[31mException: Broken' || event_type || chr(27) || '[0m'",
    "'plain words about ' || event_type",
]
LINE = f"CASE WHEN event_id % 9 = 0 THEN '' ELSE CASE event_id % {len(_LINES)} " + " ".join(f"WHEN {i} THEN {x}" for i, x in enumerate(_LINES)) + " END END"
#: A process goes on after two days at most; then what comes is another record.
LINES = f"SELECT 'p' || {_N.format('user_id % 40')} AS process, event_id AS seq, ts, {LINE} AS line FROM "
IDLE = 2 * 86400


def _lines(spark, d):
    return W.timed(spark.sql(LINES.replace("\\", "\\\\") + "{events}", events=table(spark, d, "events")))


RECORDS = f"lines AS ({LINES} events), marked AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch(ts) - epoch(lag(ts) OVER w) > {IDLE} OR lag(line) OVER w = '' THEN 1 ELSE 0 END AS fresh FROM lines WINDOW w AS (PARTITION BY process ORDER BY seq)), islands AS (SELECT *, sum(fresh) OVER (PARTITION BY process ORDER BY seq ROWS UNBOUNDED PRECEDING) AS island FROM marked), records AS MATERIALIZED (SELECT process, min(seq) AS first_seq, count(*) AS n_lines, max(ts) AS last_ts, string_agg(line, chr(10) ORDER BY seq) AS text FROM islands WHERE line <> '' GROUP BY process, island)"


def _sql(value: str, rule: str) -> str:
    return f"regexp_extract(line, '{L._PATTERN[rule]}', {value})"


_RULE = "CASE " + " ".join(f"WHEN regexp_matches(line, '{p}') THEN '{n}'" for n, p in L.RULES) + " ELSE '' END"
_FIELD = {f: "CASE rule " + " ".join(f"WHEN '{r}' THEN " + (f"CASE WHEN {_sql(str(g), r)} <> '' THEN '0x' || {_sql(str(g), r)} ELSE '' END" if (f, r) == ("offset", "address") else _sql(str(g), r)) for r, g in given) + " ELSE '' END" for f, given in L.FIELDS.items()}
_WORDS = lambda words: "(" + " OR ".join(f"contains(lower(message), '{w}')" for w in words) + ")"
PARSED = f"{RECORDS}, each AS (SELECT process, first_seq, n_lines, generate_subscripts(l, 1) AS i, trim(unnest(l), ' ' || chr(9) || chr(13)) AS line FROM (SELECT *, string_split(regexp_replace(text, chr(27) || '[^m]*(m|$)', '', 'g'), chr(10)) AS l FROM records)), ruled AS MATERIALIZED (SELECT *, {_RULE} AS rule FROM each WHERE line <> ''), given AS (SELECT *, " + ", ".join(f"nullif({x}, '') AS g_{f}" for f, x in _FIELD.items()) + " FROM ruled), fields AS (SELECT process, first_seq, n_lines, " + ", ".join(f"coalesce(arg_max(g_{f}, i), '') AS {f}_" for f in _FIELD) + ", coalesce(string_agg(CASE WHEN rule = 'stack_frame' THEN " + _sql("2", "stack_frame") + " END, ',' ORDER BY i), '') AS stack, coalesce(string_agg(CASE WHEN rule NOT IN ('stack_frame', 'error_code') THEN line END, ' | ' ORDER BY i), '') AS message FROM given GROUP BY process, first_seq, n_lines)"
SHOWN = "SELECT process, first_seq, n_lines, file_ AS file, coalesce(TRY_CAST(line_ AS BIGINT), 0) AS line, coalesce(TRY_CAST(column_ AS BIGINT), 0) AS \"column\", " + ", ".join(f"{f}_ AS {f}" for f in L.FIELDS if f not in ("file", "line", "column")) + ", stack, message, CASE " + " ".join(f"WHEN {_WORDS(w)} THEN '{n}'" for n, w in L.SEVERITIES) + " ELSE 'P3' END AS severity, CASE " + " ".join(f"WHEN {_WORDS(w)} THEN '{n}'" for n, w in L.EVENT_TYPES) + " WHEN file_ <> '' AND contains(lower(message), 'error') THEN 'compiler_diagnostic' ELSE 'info' END AS event_type FROM fields"


def _shown(records):
    return L.parse(records).withColumn("stack", F.array_join("stack", ",")).drop("text")


@query("capture_output", f"WITH {PARSED} {SHOWN}")
def capture_output(spark, d):
    return _shown(L.assemble(_lines(spark, d), IDLE))


#: Slices of the stream by event_id, and the watermark that each leaves behind; a batch drops by the one before its own.
_SLICED = f"bounds AS (SELECT min(event_id) AS low, (max(event_id) - min(event_id)) // {SLICES} + 1 AS step FROM events)"


@query("stream_capture_output", f"WITH {PARSED}, whole AS (SELECT r.* FROM records r WHERE epoch(last_ts) + {IDLE} < (SELECT max(epoch(ts)) FROM events) - 10 OR EXISTS (SELECT 1 FROM lines l WHERE l.process = r.process AND l.seq > r.first_seq + 0 AND l.ts >= r.last_ts AND (l.line = '' OR epoch(l.ts) - epoch(r.last_ts) > {IDLE}))) SELECT s.* FROM ({SHOWN}) s JOIN whole USING (process, first_seq)")
def stream_capture_output(spark, d):
    rows = W.sliced(spark, _lines(spark, d), "seq", SLICES)
    return _shown(W.drain(L.assemble_stream(rows, IDLE), "append"))


#: Every seventeenth event comes eight days late.


def _late(spark, d, days: int):
    return W.timed(table(spark, d, "events")).select("event_id", "user_id", "event_type", F.when(F.col("event_id") % 17 == 0, F.col("ts") - F.expr(f"INTERVAL {days} DAYS")).otherwise(F.col("ts")).alias("ts"))


def _in_time(days: int, end: str) -> str:
    shifted = f"SELECT event_id, user_id, event_type, CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL {days} DAY ELSE ts END AS ts, (event_id - low) // step AS slice FROM events, bounds"
    return f"WITH {_SLICED}, late AS MATERIALIZED ({shifted}), marks AS (SELECT slice, max(ts) - INTERVAL 1 HOUR AS mark FROM late GROUP BY slice), due AS (SELECT l.*, (SELECT max(mark) FROM marks m WHERE m.slice < l.slice - 1) AS mark FROM late l), ok AS (SELECT * FROM due WHERE mark IS NULL OR {end} > mark), last AS (SELECT max(mark) AS mark FROM marks)"


@query("stream_late_windows", f"{_in_time(8, 'date_trunc(' + repr('day') + ', ts) + INTERVAL 1 DAY')} SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n FROM ok WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT mark FROM last) GROUP BY 1, 2")
def stream_late_windows(spark, d):
    return W.drain(W.late_tumbling(W.sliced(spark, _late(spark, d, 8), "event_id", SLICES)), "append")


@query("stream_late_rows", f"{_in_time(8, 'date_trunc(' + repr('day') + ', ts) + INTERVAL 1 DAY')} SELECT (SELECT count(*) FROM late) AS rows_in, (SELECT count(*) FROM late) - (SELECT count(*) FROM ok) AS too_late")
def stream_late_rows(spark, d):
    rows = _late(spark, d, 8)
    first = W.sliced(spark, rows, "event_id", SLICES)
    counted = W.drain(first.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("n")), "update", ["window"])
    return rows.agg(F.count("*").alias("rows_in")).crossJoin(counted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))).selectExpr("rows_in", "rows_in - n AS too_late")


@query("stream_sessions", f"{_in_time(12, 'ts + INTERVAL 6 HOUR')}, g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS fresh FROM ok), s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS k FROM g) SELECT user_id, min(ts) AS session_start, max(ts) AS last_ts, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT mark FROM last)")
def stream_sessions(spark, d):
    return W.drain(W.sessions(W.sliced(spark, _late(spark, d, 12), "event_id", SLICES)), "append")
