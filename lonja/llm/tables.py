"""Input tables of the queries and tolerant column access."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.llm.store import Scratch

#: Stands for a null document id.
NO_ID = -(1 << 63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(docs: DataFrame, *columns: str) -> DataFrame:
    """Only the named columns, under their own names, whatever else the table holds."""
    return docs.select(*[F.col(f"`{c}`") for c in columns])


def numbered(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """``(doc_id, _row, text)``; ``doc_id`` and ``_row`` together tell documents apart, null ids being ``NO_ID``.

    ``_row`` is zero where an id is unique, the hash of the text where it is repeated, so that rows that repeat an id and
    text stay one document, and a written number where there is no id.
    """
    docs = pick(docs, "doc_id", "text")
    known = docs.where("doc_id is not null")
    again = scratch.write(known.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    unknown = docs.where("doc_id is null").select(F.lit(NO_ID).alias("doc_id"), F.monotonically_increasing_id().alias("_row"), "text")
    unknown = scratch.write(unknown, "unknown-ids")
    row = F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).cast("long")
    return known.join(again.withColumn("again", F.lit(True)), "doc_id", "left").select("doc_id", row.alias("_row"), "text").union(unknown)
