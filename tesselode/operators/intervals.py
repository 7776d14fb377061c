"""Joins of points and spans of lines within a file, as equi-joins that make no pair that does not hold.

A span is the sum of some blocks of BASE**k lines, less than 2 * BASE of each size; a point lies in one block of each size.
Both meet by (path, size, block), and each point and span that belong together meet in one block exactly. Two spans
overlap if the one that starts later starts within the other, so an overlap is two such joins. Sizes above the last
point need no blocks. Blocks are many more rows than the planner takes them for, so no side of a join is ever broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Lines are below 2 to the power of LEVELS; a span without an end goes up to there.
LEVELS = 31
_LAST = (1 << LEVELS) - 1
#: Blocks of one size that make one of the next.
BASE = 8
#: Lines of a file whose running sums one group makes.
STRETCH = 1024


def _sizes(points: DataFrame) -> tuple[int, list[int]]:
    """The last line of a point, and the sizes of blocks up to there."""
    top = points.agg(F.max(F.when(F.col("at").between(0, _LAST), F.col("at").cast("long"))).alias("top")).first()["top"] or 0
    sizes = [1]
    while sizes[-1] * BASE <= top:
        sizes.append(sizes[-1] * BASE)
    return top, sizes


def _blocks(start: Column, end: Column, sizes: list[int]) -> Column:
    """(k, block) of a span's blocks of these sizes."""
    low = lambda size: F.call_function("div", start + size - 1, F.lit(size).cast("long"))
    high = lambda size: F.call_function("div", end + 1, F.lit(size).cast("long"))

    def run(k: int, first: Column, stop: Column) -> Column:
        blocks = F.transform(F.sequence(first, stop - 1), lambda x: F.struct(F.lit(k).alias("k"), x.alias("block")))
        return F.when(first < stop, blocks).otherwise(F.array().cast("array<struct<k:int,block:bigint>>"))

    parts = []
    for k, size in enumerate(sizes):
        if k + 1 == len(sizes):
            parts.append(run(k, low(size), high(size)))
            continue
        up, down = low(size * BASE), high(size * BASE)
        parts += [run(k, low(size), F.when(up < down, up * BASE).otherwise(high(size))), run(k, F.when(up < down, down * BASE).otherwise(high(size)), high(size))]
    return F.concat(*parts)


def _at_blocks(points: DataFrame, sizes: list[int]) -> DataFrame:
    k = F.posexplode(F.array(*[F.call_function("div", F.col("at").cast("long"), F.lit(size).cast("long")) for size in sizes])).alias("k", "block")
    return points.where(F.col("path").isNotNull() & F.col("at").between(0, _LAST)).select("*", k)


def _spans(spans: DataFrame) -> DataFrame:
    """spans with whole ends: without an end a span goes on, before line 0 there is nothing; empty ones and those of null path or start go."""
    start, end = F.greatest(F.col("start").cast("long"), F.lit(0)), F.least(F.coalesce(F.col("end").cast("long"), F.lit(_LAST)), F.lit(_LAST))
    return spans.where("path IS NOT NULL AND start IS NOT NULL").withColumns({"start": start, "end": end}).where("start <= end")


def within(points: DataFrame, spans: DataFrame) -> DataFrame:
    """Pairs of points(path, at, ..) and spans(path, start, end, ..) with start <= at <= end. The other columns of both pass through and must have names of their own."""
    top, sizes = _sizes(points)
    s = _spans(spans)
    s = s.select("*", F.explode(_blocks(F.col("start"), F.least("end", F.lit(top)), sizes)).alias("x")).select(*s.columns, "x.k", "x.block")
    return _at_blocks(points, sizes).hint("merge").join(s, ["path", "k", "block"]).drop("k", "block")


def overlaps(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs (path, left_id, right_id, first, last) of left and right (path, start, end, id) that share a line, and the lines they share."""
    a = _spans(left).select("path", "start", "end", F.col("id").alias("left_id"))
    b = _spans(right).select("path", "start", "end", F.col("id").alias("right_id"))
    point = lambda df, name: df.select("path", F.col("start").alias("at"), F.col("end").alias("stop"), name)
    one = within(point(a, "left_id"), b)  # the left one starts within the right one
    two = within(point(b, "right_id"), a).where("at > start")
    cols = ["path", "left_id", "right_id", F.col("at").alias("first"), F.least("stop", "end").alias("last")]
    return one.select(*cols).unionByName(two.select(*cols))


def touched(spans: DataFrame, hunks: DataFrame) -> DataFrame:
    """(id, hunks, lines) of spans(path, start, end, id) that share a line with hunks(path, start, end): how many, and lines shared in all; no pair is made.

    Up to a line x, hunks that started by x less those that ended by x cover what running sums of their counts, starts and ends tell.
    Sums run over positions within stretches of STRETCH lines, and over the stretches of a file, at most 2**LEVELS / STRETCH.
    """
    s, h = _spans(spans), _spans(hunks)
    sums = ["n_start", "s_start", "n_end", "s_end"]
    none = [F.lit(0).cast("long").alias(c) for c in sums]
    one = F.lit(1).cast("long")
    starts = h.select("path", F.col("start").alias("at"), one.alias(sums[0]), F.col("start").alias(sums[1]), *none[2:])
    ends = h.select("path", F.col("end").alias("at"), *none[:2], one.alias(sums[2]), F.col("end").alias(sums[3]))
    # a span asks for the sums at its end and before its start
    asked = s.select("path", F.explode(F.array(F.col("start") - 1, F.col("end"))).alias("at"), *none)
    at = starts.unionByName(ends).unionByName(asked).groupBy("path", "at").agg(*[F.sum(c).alias(c) for c in sums])
    at = at.withColumn("stretch", F.floor(F.col("at") / STRETCH))
    before = Window.partitionBy("path").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    whole = at.groupBy("path", "stretch").agg(*[F.sum(c).alias(c) for c in sums]).select("path", "stretch", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_0") for c in sums])
    so_far = Window.partitionBy("path", "stretch").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    at = at.select("path", "stretch", "at", *[F.sum(c).over(so_far).alias(c) for c in sums]).hint("merge").join(whole, ["path", "stretch"])
    n_start, s_start, n_end, s_end = (F.col(c) + F.col(f"{c}_0") for c in sums)
    x = F.col("at")
    at = at.select("path", x, n_start.alias("begun"), n_end.alias("over"), (n_start * (x + 1) - s_start - n_end * x + s_end).alias("lines"))
    # each span is two rows, which meet their positions and are summed by id
    ends = s.select("path", "id", F.explode(F.array(F.struct((F.col("start") - 1).alias("at"), F.lit(-1).alias("sign")), F.struct(F.col("end").alias("at"), F.lit(1).alias("sign")))).alias("e")).select("path", "id", "e.at", "e.sign")
    met = ends.hint("merge").join(at, ["path", "at"])
    n = F.when(F.col("sign") > 0, F.col("begun")).otherwise(-F.col("over"))
    return met.groupBy("id").agg(F.sum(n).alias("hunks"), F.sum(F.col("sign") * F.col("lines")).alias("lines")).where("hunks > 0")


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """(point_id, span_id) of points(path, at, point_id): the shortest span around each, of equal ones the later start, then the least id. Points in no span give nothing.

    Of the spans that hold a block the best stays, so a point meets one row of each size, however many spans are around it.
    """
    top, sizes = _sizes(points)
    s = _spans(spans)
    own = F.struct((F.col("end") - F.col("start")).alias("size"), (-F.col("start")).alias("back"), F.col("id").alias("span_id"))
    s = s.select("path", own.alias("own"), F.explode(_blocks(F.col("start"), F.least("end", F.lit(top)), sizes)).alias("x"))
    best = s.groupBy("path", F.col("x.k").alias("k"), F.col("x.block").alias("block")).agg(F.min("own").alias("own"))
    met = _at_blocks(points.select("path", "at", "point_id"), sizes).hint("merge").join(best, ["path", "k", "block"])
    return met.groupBy("point_id").agg(F.min("own").alias("x")).select("point_id", F.col("x.span_id").alias("span_id"))
