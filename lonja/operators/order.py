"""Spreadsheet order, ranks and running numbers.

Blank cells come last in both directions; numbers stand before text by value, text by lower-cased bytes. Sorting is
Spark's range-partitioned sort, ties by ``order``. Ranks over all rows come from the sorted ranges: each range is
numbered by itself and shifted by the sizes of the ranges before, so no task holds more than its range.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import char_count, finite_number, trim_space


def sheet_order(column: Column | str, ascending: bool = True) -> list[Column]:
    """Sort keys of the spreadsheet order."""
    text = trim_space(F.col(f"`{column}`") if isinstance(column, str) else column)
    number = finite_number(text)
    blank = F.coalesce(text == "", F.lit(True))
    keys = [F.when(number.isNotNull(), 0).otherwise(1), number, F.lower(text)]
    return [blank.asc(), *[k.asc_nulls_last() if ascending else k.desc_nulls_last() for k in keys]]


def sort_sheet(df: DataFrame, column: str, ascending: bool = True, order: str = "_ord") -> DataFrame:
    return df.orderBy(*sheet_order(column, ascending), F.col(order).asc())


def sort_by_length(df: DataFrame, column: str, ascending: bool = True, order: str = "_ord") -> DataFrame:
    size = char_count(column)
    return df.orderBy(size.asc() if ascending else size.desc(), F.col(order).asc())


def number_rows(df: DataFrame, keys: list[Column], name: str = "rank", start: int = 1) -> DataFrame:
    """Consecutive numbers in the order of ``keys``, which must be total."""
    # Persisted so that the sizes and the rows come from one and the same set of ranges.
    ranged = df.orderBy(*keys).withColumn("_part", F.spark_partition_id()).withColumn("_seq", F.monotonically_increasing_id()).persist(StorageLevel.DISK_ONLY)
    first = ranged.groupBy("_part").agg(F.min("_seq").alias("_low"), F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = first.select("_part", "_low", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_seq") - F.col("_low") + F.col("_base") + start).drop("_part", "_seq", "_low", "_base")


def running_number(df: DataFrame, key: str, order: str = "_ord", name: str = "running") -> DataFrame:
    """1, 2, … for the rows of each key in order."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(key).orderBy(order)).cast("long"))


def prefix_sum(df: DataFrame, value: str, order: str, name: str = "before") -> DataFrame:
    """Sum of the values of all earlier rows; for small control tables such as inserted columns."""
    return df.withColumn(name, F.coalesce(F.sum(value).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def trim_blank_tail(df: DataFrame, columns: list[str], order: str = "_ord") -> DataFrame:
    """Drops the rows after the last one with a value; blank rows before it stay."""
    filled = " or ".join(f"coalesce(`{c}`, '') <> ''" for c in columns)
    last = df.where(filled).agg(F.max(order).alias("_last"))
    return df.join(F.broadcast(last), F.col(order) <= F.col("_last"), "left_semi")
