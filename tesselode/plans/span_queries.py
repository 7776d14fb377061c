"""Spans of functions, lines and hunks in files built from orders: where a line belongs, what a change touches."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.operators import intervals as N
from tesselode.sources.tables import table

from .catalog import query

#: A customer is a file, an order a function in it: some nested, every 97th without an end, every 101st of no lines.
SPANS = "SELECT o_custkey AS path, o_orderkey * 37 % 5000 AS start, CASE WHEN o_orderkey % 97 = 0 THEN NULL WHEN o_orderkey % 101 = 0 THEN o_orderkey * 37 % 5000 - 1 ELSE o_orderkey * 37 % 5000 + o_orderkey * 11 % 3000 END AS {end}, o_orderkey AS id FROM {orders}"
#: A line item is a line of its order's file, and a hunk of as many lines as its quantity.
POINTS = "SELECT o_custkey AS path, l_partkey * 13 % 6000 AS at, l_orderkey * 8 + l_linenumber AS point_id, CAST(l_quantity AS BIGINT) AS size FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey"
_SPANS = SPANS.format(orders="orders", end='"end"')
_POINTS = POINTS.format(orders="orders", lineitem="lineitem")
WITH = f"WITH f AS MATERIALIZED (SELECT path, start, coalesce(\"end\", {N._LAST}) AS stop, id FROM ({_SPANS})), p AS MATERIALIZED ({_POINTS})"


def _both(spark, d):
    orders, lineitem = table(spark, d, "orders"), table(spark, d, "lineitem")
    return spark.sql(SPANS.replace("{end}", "`end`"), orders=orders), spark.sql(POINTS, orders=orders, lineitem=lineitem)


@query("resolve_source_span", f"{WITH} SELECT point_id, id AS span_id FROM p JOIN f ON f.path = p.path AND f.start <= p.at AND p.at <= f.stop QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY stop - start, start DESC, id) = 1")
def resolve_source_span(spark, d):
    spans, points = _both(spark, d)
    return N.innermost(points, spans)


@query("pr_context", f"{WITH} SELECT id, count(*) AS hunks, CAST(sum(least(stop, p.at + size - 1) - greatest(start, p.at) + 1) AS BIGINT) AS lines FROM p JOIN f ON f.path = p.path AND f.start <= p.at + p.size - 1 AND p.at <= f.stop WHERE size > 0 AND start <= stop GROUP BY id")
def pr_context(spark, d):
    spans, points = _both(spark, d)
    hunks = points.select("path", F.col("at").alias("start"), (F.col("at") + F.col("size") - 1).alias("end"), F.col("point_id").alias("id"))
    return N.touched(spans, hunks)
