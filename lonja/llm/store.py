"""Written intermediate tables in the folder that the whole cluster shares.

An iterative or two-pass operator cuts its lineage here: the table is written as Parquet under
``spark.checkpoint.dir`` and read back, so a lost executor costs a re-read, not a recomputation. Nothing is kept in
executor-local storage. A local session without that setting (tests, a laptop) gets a folder of its own, once; on a
cluster a folder of one machine would be lost to the others, so that is an error.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_own: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder: ``spark.checkpoint.dir``, else what ``setCheckpointDir`` named; a temporary one locally."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
    context = id(spark.sparkContext)
    if context not in _own:
        _own[context] = "file://" + tempfile.mkdtemp(prefix="lonja-shared-")
    return _own[context]


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def small_batches(spark: SparkSession):
    """Fewer rows at once between the JVM and Python, whose both copies of a batch count against an executor's memory."""
    return settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000")


class Scratch:
    """One query's folder of intermediate tables.

    ``write`` stores a frame and returns the stored rows; ``drop`` deletes a table that later steps no longer read.
    What is left when the process ends is deleted then, since a returned lazy frame may still read it.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/lonja-{name}-{uuid.uuid4().hex}"
        atexit.register(self._sweep)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, frame: DataFrame, table: str, **options: object) -> DataFrame:
        writer = frame.write.mode("overwrite").option("compression", "zstd")
        for key, value in options.items():
            writer = writer.option(key.replace("__", "."), value)
        with small_batches(self.spark):
            writer.parquet(self.path(table))
        schema = frame.schema
        del frame, writer
        self.release()
        return self.spark.read.schema(schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        for table in tables:
            delete(self.spark, self.path(table))

    def release(self) -> None:
        """Lets Spark's cleaner remove the shuffle files of finished, unreferenced plans."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()

    def _sweep(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session has ended; its folder goes with it
            pass


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings for the actions inside the block; keys use ``__`` for dots."""
    before = {}
    for key, value in values.items():
        key = key.replace("__", ".")
        before[key] = spark.conf.get(key, None)
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)
