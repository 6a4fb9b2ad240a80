"""Bounded-batch and incremental runs over arriving files.

Stateless steps (normalising, judging titles) run as a stream with the available-now trigger; its checkpoint is the
resume point. Keep-first over an unbounded stream needs every key ever seen as state, which ``first_seen`` holds in
Spark's state store; whole-table results (keep-cheapest, running numbers) stay batch operators over what is written.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lonja.functions.text import clean_key


def run_available(spark: SparkSession, source: str, schema: str, step: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, fmt: str = "parquet") -> StreamingQuery:
    """Applies a step to the files that are there and not yet done, appends the result, and stops."""
    stream = spark.readStream.schema(schema).format(fmt).load(source)
    query = step(stream).writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(target)
    query.awaitTermination()
    return query


def first_seen(stream: DataFrame, column: str) -> DataFrame:
    """Rows whose clean key has not been seen before; blank keys pass."""
    keyed = stream.withColumn("_k", clean_key(column))
    named = keyed.withColumn("_k", F.when(F.col("_k") == "", F.uuid()).otherwise(F.col("_k")))
    return named.dropDuplicates(["_k"]).drop("_k")


def each_batch(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands every available micro-batch to a consumer, exactly once for an idempotent one."""
    query = stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query
