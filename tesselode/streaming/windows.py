"""Event streams: windowed and stateful aggregates, run over what is there (availableNow)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselode.functions.text_rules import severity, template
from tesselode.sources.tables import scratch


def source(spark: SparkSession, sf_dir: str, name: str = "events") -> DataFrame:
    """A table as a stream of files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return timed(spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/{name}.parquet*"))


def timed(events: DataFrame) -> DataFrame:
    """Event time as an instant (watermarks need one); the session's zone is UTC."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(c: Column) -> Column:
    return c.cast("timestamp_ntz")


def drain(stream: DataFrame, mode: str, key: list[str] | None = None) -> DataFrame:
    """Everything a stream yields, exactly once: each micro-batch is a folder of its own, written anew if it is repeated.

    In update mode the last row of a key stands.
    """
    spark = stream.sparkSession
    base = scratch(spark, "stream")

    def put(batch: DataFrame, epoch: int) -> None:
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{base}/out/epoch={epoch}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if not q.lastProgress:
        return spark.createDataFrame([], stream.schema)
    out = spark.read.parquet(f"{base}/out/*")
    if mode == "update" and key:
        rest = [c for c in out.columns if c not in key]
        out = out.groupBy(*key).agg(F.max_by(F.struct(*rest), "epoch").alias("x")).select(*key, *[F.col(f"x.{c}").alias(c) for c in rest])
    return out.drop("epoch")


def sliced(spark: SparkSession, rows: DataFrame, by: str, slices: int) -> DataFrame:
    """rows as a stream of `slices` micro-batches, in order of a whole-number column: each is a file of its own."""
    path, schema = scratch(spark, "slices"), rows.schema
    low, high = rows.agg(F.min(by), F.max(by)).first()
    if low is None:
        low = high = 0
    step = (high - low) // slices + 1
    for i in range(slices):
        part = rows.where((F.col(by) >= low + i * step) & (F.col(by) < low + (i + 1) * step))
        part.coalesce(1).write.parquet(f"{path}/{i:04}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{path}/*")


def late_tumbling(events: DataFrame, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Windows that have closed, each once; rows that come after their window's end is passed by the watermark are lost to it."""
    w = events.withWatermark("ts", delay).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"))
    return w.select(_plain(F.col("window.start")).alias("window_start"), "event_type", "n")


def tumbling(events: DataFrame, size: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return w.select(_plain(F.col("window.start")).alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "2 days", step: str = "1 day") -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.window("ts", size, step), "event_type").agg(F.count("*").alias("n"))
    return w.select(_plain(F.col("window.start")).alias("window_start"), "event_type", "n")


def sessions(events: DataFrame, gap: str = "6 hours") -> DataFrame:
    w = events.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return w.select("user_id", _plain(F.col("session_window.start")).alias("session_start"), _plain(F.expr(f"session_window.end - interval {gap}")).alias("last_ts"), "n")


def lines(events: DataFrame) -> DataFrame:
    """events as log lines (ts, event_id, line)."""
    word = F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "purchase", "WARN").otherwise("INFO")
    return events.select("ts", "event_id", F.concat(word, F.lit(": user "), F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"), F.lit(" code "), (F.col("event_id") % 7).cast("string")).alias("line"))


def templates(events: DataFrame) -> DataFrame:
    x = lines(events).select(template(F.col("line")).alias("template"), severity(F.col("line")).alias("severity"), "ts")
    return x.groupBy("template", "severity").agg(F.count("*").alias("n"), _plain(F.min("ts")).alias("first_ts"), _plain(F.max("ts")).alias("last_ts"))


def distinct_users(events: DataFrame) -> DataFrame:
    return events.withWatermark("ts", "1 hour").dropDuplicates(["user_id", "event_type"]).select("user_id", "event_type")


Stream = Callable[[DataFrame], DataFrame]
