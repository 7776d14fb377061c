"""Reading the tables, and the key graph that their keys span."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL = "/tmp/tesselode-checkpoints"
#: Bytes of rows that a task takes out of a batch at once.
PIECE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir, the folder that driver and executors share; only a local master may leave it unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{(folder or LOCAL).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again, so that an iteration starts from files."""
    path = scratch(df.sparkSession, "step")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of batches, of PIECE_BYTES at most or a single row at once, so that what is made of them stays small however many rows a batch has."""
    for batch in batches:
        todo = [batch]
        while todo:
            x = todo.pop()
            if x.num_rows < 2 or x.nbytes <= PIECE_BYTES:
                yield x
            else:
                todo += [x.slice(x.num_rows // 2), x.slice(0, x.num_rows // 2)]


def _id(prefix: str, column: str):
    return F.concat(F.lit(prefix + ":"), F.col(column).cast("string"))


#: (table, kind, key, name) of the nodes; orders are named by their status.
NODES = [("region", "Region", "r_regionkey", "r_name"), ("nation", "Nation", "n_nationkey", "n_name"), ("customer", "Customer", "c_custkey", "c_name"), ("supplier", "Supplier", "s_suppkey", "s_name"), ("part", "Part", "p_partkey", "p_name"), ("orders", "Order", "o_orderkey", "o_orderstatus")]
#: (table, kind, from kind, from key, to kind, to key) of the edges.
EDGES = [("nation", "IN_REGION", "Nation", "n_nationkey", "Region", "n_regionkey"), ("customer", "IN_NATION", "Customer", "c_custkey", "Nation", "c_nationkey"), ("supplier", "IN_NATION", "Supplier", "s_suppkey", "Nation", "s_nationkey"), ("orders", "PLACED", "Customer", "o_custkey", "Order", "o_orderkey"), ("lineitem", "CONTAINS", "Order", "l_orderkey", "Part", "l_partkey"), ("lineitem", "SUPPLIED_BY", "Part", "l_partkey", "Supplier", "l_suppkey")]


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nodes(id, kind, name) of the key graph."""
    from tesselode.operators.graph import union_all

    return union_all([table(spark, sf_dir, t).select(_id(kind, key).alias("id"), F.lit(kind).alias("kind"), F.col(name).alias("name")) for t, kind, key, name in NODES])


def edges(spark: SparkSession, sf_dir: str, kinds: list[str] | None = None) -> DataFrame:
    """edges(id, kind, from_id, to_id) of the key graph, each once; keys are shuffled, texts are made of what is left."""
    from tesselode.operators.graph import union_all

    parts = [table(spark, sf_dir, t).select(x, y).distinct().select(_id(a, x).alias("from_id"), _id(b, y).alias("to_id")).select(F.concat_ws("|", F.lit(kind), "from_id", "to_id").alias("id"), F.lit(kind).alias("kind"), "from_id", "to_id") for t, kind, a, x, b, y in EDGES if not kinds or kind in kinds]
    return union_all(parts)


def key_number(kind: str, column: str):
    """A node of the key graph as a number: its key and, in the last three bits, its kind."""
    return F.col(column).cast("long") * 8 + [x[1] for x in NODES].index(kind)


def key_text(number):
    """The id of a node's number."""
    kinds = F.array(*[F.lit(f"{x[1]}:") for x in NODES])
    return F.concat(F.element_at(kinds, number.bitwiseAND(7).cast("int") + 1), F.shiftright(number, 3).cast("string"))


def key_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, to_id) of the key graph as numbers; an edge may stand more than once, null ends are left out."""
    from tesselode.operators.graph import union_all

    parts = [table(spark, sf_dir, t).select(key_number(a, x).alias("from_id"), key_number(b, y).alias("to_id")) for t, _, a, x, b, y in EDGES]
    return union_all(parts).where("from_id IS NOT NULL AND to_id IS NOT NULL")


NODES_SQL = " UNION ALL ".join(f"SELECT '{kind}:' || CAST({key} AS VARCHAR) AS id, '{kind}' AS kind, {name} AS name FROM {t}" for t, kind, key, name in NODES)
EDGES_SQL = " UNION ALL ".join(f"SELECT DISTINCT '{kind}|{a}:' || CAST({x} AS VARCHAR) || '|{b}:' || CAST({y} AS VARCHAR) AS id, '{kind}' AS kind, '{a}:' || CAST({x} AS VARCHAR) AS from_id, '{b}:' || CAST({y} AS VARCHAR) AS to_id FROM {t}" for t, kind, a, x, b, y in EDGES)
GRAPH_SQL = f"nodes AS ({NODES_SQL}), edges AS ({EDGES_SQL})"
