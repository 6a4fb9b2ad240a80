"""Verdict store: JSON lines ``{idx, col, approved, reason}``, appended batch by batch, last one wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "idx long, col string, approved boolean, reason string"


def append_verdicts(verdicts: DataFrame, path: str, batch: int) -> None:
    """Adds a batch; later batches have higher numbers."""
    verdicts.select("idx", "col", "approved", "reason").withColumn("batch", F.lit(batch)).write.mode("append").json(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def next_batch(spark: SparkSession, path: str) -> int:
    """A number above those of all batches in the store."""
    if not _exists(spark, path):
        return 0
    return (spark.read.schema("batch int").option("mode", "DROPMALFORMED").json(path).agg(F.max("batch")).first()[0] or 0) + 1


def load_verdicts(spark: SparkSession, path: str) -> DataFrame:
    """The last verdict of each cell; none where there is no store yet. Damaged lines are ignored."""
    if not _exists(spark, path):
        return spark.createDataFrame([], SCHEMA)
    rows = spark.read.schema(SCHEMA + ", batch int").option("mode", "DROPMALFORMED").json(path).where("idx is not null and col is not null")
    last = rows.groupBy("idx", "col").agg(F.max(F.struct(F.coalesce("batch", F.lit(0)).alias("b"), "approved", "reason")).alias("v"))
    return last.select("idx", "col", "v.approved", "v.reason")
