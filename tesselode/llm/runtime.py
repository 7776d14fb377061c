"""What the training-data operators share on the Spark side."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Where intermediate tables go if a local session names no folder (tests, a laptop).
LOCAL_CHECKPOINTS = "/tmp/tesselode-checkpoints"
#: Rows of a key below which it is never split out of a join.
HOT = 64


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a local master may leave it unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return LOCAL_CHECKPOINTS


def tune(spark: SparkSession) -> None:
    """Arrow batches small in rows and bytes, so that a worker never holds many long texts at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df lacks, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    name = f"__{name}"
    while name.lower() in taken:
        name += "_"
    return name


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def materialise(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: what follows starts from files that outlive any executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def attach(left: DataFrame, right: DataFrame, keys: list[str], size: str, how: str = "inner") -> DataFrame:
    """left joined to right, which has a row for each key with the number of left's rows of it in `size`.

    A key with more than a quarter of a partition's even share never meets in one task: these keys, fewer than four for
    each partition as their rows add up to no more than left's, are broadcast. left and right should be written tables.
    """
    spark = left.sparkSession
    total = right.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    limit = max(HOT, total // (4 * partitions(spark)))
    hot = right.where(F.col(size) > limit).select(keys).collect()
    if not hot:
        return left.join(right, keys, how)
    named = F.broadcast(spark.createDataFrame([tuple(r) for r in hot], right.select(keys).schema))
    few = F.broadcast(right.join(named, keys, "left_semi"))
    return left.join(few, keys).unionByName(left.join(named, keys, "left_anti").join(right, keys, how))
