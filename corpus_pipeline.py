"""The corpus pipeline: STAGES over documents, each written and read again before the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesselode.llm.decontaminate import drop_leaks
from tesselode.llm.minhash_dedup import drop_near_duplicates
from tesselode.llm.packing import pack
from tesselode.llm.queries import tokenizer_path
from tesselode.llm.repeats import ADDED
from tesselode.llm.rlz_dedup import rlz_dedup
from tesselode.llm.runtime import fresh, shared_dir
from tesselode.llm.toxicity import THRESHOLD, fit, score


def _aside(docs: DataFrame, added: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names put under others, and the way back."""
    back, out = {}, docs
    for c in [c for c in docs.columns if c.lower() in added]:
        other = fresh(out, c)
        back[other] = c
        out = out.withColumnRenamed(c, other)
    return out, back


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that score below the threshold; learns from every label that a document of the stage has.

    Null and empty texts score as examples without terms do; repeated rows score alike; no rows give none.
    """
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    own, back = _aside(docs, ["score"])
    scored = score(own, model)
    return scored.where(F.col("score") < THRESHOLD).drop("score").withColumnsRenamed(back).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each near-duplicate group. Texts without words and null ids are in no group."""
    return drop_near_duplicates(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that a document with a smaller id holds; a document of which nothing is left goes, one that was empty stays."""
    own, back = _aside(docs, ADDED)
    out = rlz_dedup(own, keep_text=True)
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_tokens")))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.drop(*ADDED).withColumnsRenamed(back).select(docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that leak a benchmark item; one with a null id stays, as it cannot be named."""
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences; a null text is empty and has its end id alone."""
    return pack(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]

#: Similarity search, tries at a likelihood and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
