"""Repeated keys, keep-first, membership and keep-cheapest.

Choices per key are partial aggregates of whole rows, not windows over the key: a key that holds a large share of all rows
is combined before the shuffle, and the table is read once. Where the other rows are wanted too, the choice is joined
back. ``order`` names a column that is unique and gives the reading order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import clean_key, finite_number


def distinct_keys(df: DataFrame, column: str) -> DataFrame:
    """``(key)``: the non-blank clean keys."""
    return df.select(clean_key(column).alias("key")).where("key <> ''").distinct()


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """``(key, times)`` of the keys that occur more than once."""
    return df.select(clean_key(column).alias("key")).where("key <> ''").groupBy("key").agg(F.count("*").alias("times")).where("times > 1")


def repeated_total(df: DataFrame, column: str) -> DataFrame:
    """One row: repeated keys and the rows that they stand in."""
    return repeated_keys(df, column).agg(F.count("*").alias("keys"), F.coalesce(F.sum("times"), F.lit(0)).alias("rows"))


def _least(df: DataFrame, keys: list[Column], by: Column) -> DataFrame:
    """The row of the least ``by`` for each value of the keys, with the columns of ``df``."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    best = df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.min_by(row, by).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def _marked(df: DataFrame, column: str, order: str) -> DataFrame:
    keyed = df.withColumn("_k", clean_key(column))
    groups = keyed.where("_k <> ''").groupBy(F.col("_k").alias("_g")).agg(F.count("*").alias("_n"), F.min(order).alias("_first"))
    return keyed.join(groups.where("_n > 1"), F.col("_k") == F.col("_g"), "left")


def duplicate_report(df: DataFrame, column: str, order: str = "_ord") -> DataFrame:
    """All rows of repeated keys."""
    return _marked(df, column, order).where("_n > 1").drop("_k", "_g", "_n", "_first")


def without_duplicates(df: DataFrame, column: str, order: str = "_ord") -> DataFrame:
    """The first row of each repeated key and every other row; blank keys always stay."""
    key = clean_key(column)
    return _least(df, [key, F.when(key == "", F.col(order))], F.col(order))


def keep_first(df: DataFrame, key: str, order: str = "_ord") -> DataFrame:
    """The first row of each value of ``key``."""
    return _least(df, [F.col(f"`{key}`")], F.col(order))


def rows_with_key_in(df: DataFrame, column: str, other: DataFrame, other_column: str, inside: bool = True) -> DataFrame:
    """Rows whose clean key is (not) a key of the other table. Blank keys are in no table."""
    keys = distinct_keys(other, other_column)
    return df.withColumn("_k", clean_key(column)).join(keys, F.col("_k") == F.col("key"), "left_semi" if inside else "left_anti").drop("_k")


def sortable_price(value: Column | str) -> Column:
    """The price, plus infinity if it is no finite number."""
    return F.coalesce(finite_number(value), F.lit(float("inf")))


def _by_price(price: str, order: str) -> Column:
    return F.struct(sortable_price(F.col(f"`{price}`").cast("string")).alias("p"), F.col(order).alias("o"))


def rank_by_price(df: DataFrame, key: str, price: str, order: str = "_ord") -> DataFrame:
    """Adds ``cheapest``: true for the row of lowest price of each key, the earliest in a tie."""
    priced = df.withColumn("_p", _by_price(price, order))
    best = priced.groupBy(F.col(key).alias("_g")).agg(F.min("_p").alias("_best"))
    return priced.join(best, F.expr(f"`{key}` <=> _g")).withColumn("cheapest", F.expr("_p.o = _best.o")).drop("_p", "_g", "_best")


def keep_cheapest(df: DataFrame, key: str, price: str, order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """Survivors, and the dearer rows with the reason."""
    ranked = rank_by_price(df, key, price, order)
    lost = ranked.where("not cheapest").drop("cheapest").withColumn("Motivo_Eliminacion", F.lit("Duplicado - precio más alto"))
    return _least(df, [F.col(f"`{key}`")], _by_price(price, order)), lost
