"""Documents written to word-processing and spreadsheet files of 64 each, and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tesselode.sources import office as O
from tesselode.sources.tables import scratch, settle, table

from .catalog import query

#: The first 64 ids are paragraphs, the next 64 rows of a sheet, and so on. Blanks of any sort are one blank.
_CLEAN = "trim(regexp_replace(coalesce(text, ''), '[{control} ]+', ' '{all}))"
_SQL = _CLEAN.format(control="\\x00-\\x1F", all=", 'g'")
_FILE = "CAST(doc_id // 64 AS VARCHAR(20)) || CASE WHEN doc_id // 64 % 2 = 0 THEN '.docx' ELSE '.xlsx' END"


@query("office_round_trip", f"SELECT {_FILE} AS file, doc_id, length({_SQL}) AS n_chars, md5({_SQL}) AS digest FROM documents")
def office_round_trip(spark, d):
    docs = table(spark, d, "documents").where("doc_id IS NOT NULL")
    clean = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), "[\\x00-\\x1F ]+", " "))
    bucket = F.floor(F.col("doc_id") / 64)
    name = F.concat(bucket.cast("string"), F.when(bucket % 2 == 0, ".docx").otherwise(".xlsx"))
    folder = scratch(spark, "office")
    written = O.write_office(docs.select(name.alias("file"), F.col("doc_id").alias("row"), F.array(F.col("doc_id").cast("string"), clean).alias("cells")), folder)
    settle(written)
    rows = O.read_office(spark, folder)
    line = F.when(F.col("kind") == "docx", F.col("cells")[0]).otherwise(F.array_join("cells", " "))
    text = F.regexp_replace("line", "^[0-9]+ ", "")
    back = rows.withColumn("line", line).select(F.regexp_extract("path", "([^/]*)$", 1).alias("file"), F.regexp_extract("line", "^([0-9]+) ", 1).cast("long").alias("doc_id"), text.alias("text"))
    return back.select("file", "doc_id", F.length("text").cast("long").alias("n_chars"), F.md5(F.col("text").cast("binary")).alias("digest"))
