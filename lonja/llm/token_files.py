"""Token-ID files: Parquet list columns that allow selective reads of tokens or of metadata alone.

File format
    One Parquet data set. Each file is one range of documents in ascending ``doc_id`` order, and file names follow that
    order. Columns: ``part`` (number of the range), ``doc_id``, ``local_start`` (ids of earlier documents in the range),
    ``n_tokens`` and ``ids``, a list of 32-bit integers. ``ids`` is dictionary encoded: the ids of a vocabulary of up to
    65 thousand take at most 16 bits each before compression. The integer metadata columns are written without a
    dictionary by the version 2 writer, which gives them delta encoding. Row groups and pages are small and carry page
    indexes, so a reader that looks for a few documents skips the rest, and one that wants only lengths or offsets never
    touches ``ids``.

Order
    Nulls in ``doc_id`` come first; rows with equal ``doc_id`` are ordered by a hash of their text, then by the text.
    Equal rows are interchangeable. One ``doc_id`` may be spread over several ranges and so may hold any share of rows.

Edge cases
    A null text counts as empty and gives only the end id. An empty table gives an empty data set. Extra input columns
    are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lonja.llm.bpe import encoder
from lonja.llm.store import small_batches
from lonja.llm.tables import pick

#: Writer settings: row groups, pages, encodings.
WRITER = {
    "parquet.block.size": 16 * 1024 * 1024,
    "parquet.page.size": 256 * 1024,
    "parquet.page.row.count.limit": 2_000,
    "parquet.dictionary.page.size": 1024 * 1024,
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#part": "false",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "compression": "zstd",
}


def _encode(path: str, end_id: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, start = encoder(path), 0
        for batch in batches:
            for low, high, lengths, ids in find.encode(batch.column("text")):
                if end_id is not None:
                    ids = np.insert(ids, np.cumsum(lengths), np.uint32(end_id))
                    lengths = lengths + 1
                offsets = np.concatenate([[0], np.cumsum(lengths)])
                piece = batch.slice(low, high - low)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.view(np.int32)))
                starts = pa.array(start + offsets[:-1])
                start += int(offsets[-1])
                pa.default_memory_pool().release_unused()
                yield pa.RecordBatch.from_arrays([piece.column("part"), piece.column("doc_id"), starts, pa.array(lengths), lists], ["part", "doc_id", "local_start", "n_tokens", "ids"])

    return run


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int | None = 0, ranges: int | None = None) -> None:
    """Encodes ``docs(doc_id, text)`` and writes the data set at ``path`` (any file system Spark writes to)."""
    spark = docs.sparkSession
    ranges = ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    dealt = pick(docs, "doc_id", "text").repartitionByRange(ranges, *order).sortWithinPartitions(*order, "text")
    coded = dealt.withColumn("part", F.spark_partition_id()).mapInArrow(_encode(tokenizer_path, end_id), "part int, doc_id long, local_start long, n_tokens long, ids array<int>")
    writer = coded.write.mode("overwrite")
    for key, value in WRITER.items():
        writer = writer.option(key, value)
    with small_batches(spark):
        writer.parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the data set with ``start``, the number of ids of all documents before. Only the columns used are read.

    The offsets of the ranges come from the metadata columns; their table has one row for each written range.
    """
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("part").agg(F.sum("n_tokens").alias("size"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = sizes.select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(base), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start")


def _crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    for batch in batches:
        ids = batch.column("ids")
        values, at = ids.values.to_numpy().astype("<u4", copy=False), ids.offsets.to_numpy()
        crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(at).astype(np.int64)), pa.array(crc, pa.int64())], names)


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id, start, n_tokens, ids_crc32``."""
    rows = read_tokens(spark, path).select("doc_id", "start", "ids")
    return rows.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
