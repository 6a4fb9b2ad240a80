"""Row-wise operators: ordered splits by reason, deletion with left shift, compaction, splits by length."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import any_of, as_col, char_count, trim_space
from lonja.functions.urls import has_value

REASON = "Motivo_Eliminacion"


def split_by_reason(df: DataFrame, reasons: Sequence[tuple[Column, str]], name: str = REASON) -> tuple[DataFrame, DataFrame]:
    """Rows that no condition meets, and the others with the reason of the first condition that does."""
    label = F.lit(None).cast("string")
    for condition, reason in reversed(reasons):
        label = F.when(condition, F.lit(reason)).otherwise(label)
    labelled = df.withColumn(name, label)
    return labelled.where(F.col(name).isNull()).drop(name), labelled.where(F.col(name).isNotNull())


def delete_shift(df: DataFrame, columns: Sequence[str], matches: Callable[[str, Column], Column], all_reason: str, empty_reason: str, name: str = "Motivo_Borrado") -> tuple[DataFrame, DataFrame]:
    """Deletes the matching cells of the chosen columns and packs what is left to the left.

    A row of which nothing is left goes to the second frame, with the reason: all cells matched, or the others were
    blank. Rows without a match stay exactly as they are. No usable column: all rows stay.
    """
    chosen = [c for c in columns if c in df.columns]
    if not chosen:
        return df, df.withColumn(name, F.lit(None).cast("string")).where(F.lit(False))
    cells = F.array(*[F.struct(F.coalesce(matches(c, F.col(f"`{c}`")), F.lit(False)).alias("hit"), F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias("v")) for c in chosen])
    marked = df.withColumn("_cells", cells)
    marked = marked.withColumn("_hits", F.expr("size(filter(_cells, c -> c.hit))"))
    live = F.filter(F.transform(F.expr("filter(_cells, c -> not c.hit)"), lambda c: trim_space(c["v"])), lambda v: v != "")
    marked = marked.withColumn("_live", live)
    gone = (F.col("_hits") > 0) & (F.size("_live") == 0)
    packed = {c: F.when(F.col("_hits") > 0, F.coalesce(F.get("_live", F.lit(i)), F.lit(""))).otherwise(F.col(f"`{c}`")) for i, c in enumerate(chosen)}
    extra = ["_cells", "_hits", "_live"]
    kept = marked.where(~gone).withColumns(packed).drop(*extra)
    reason = F.when(F.col("_hits") == len(chosen), all_reason).otherwise(empty_reason)
    return kept.select(*[F.col(f"`{c}`") for c in df.columns]), marked.where(gone).withColumn(name, reason).drop(*extra)


def holds_word(words: Sequence[str]) -> Callable[[str, Column], Column]:
    """A cell predicate: any of the words as a substring, case ignored; null never matches."""
    pattern = any_of(words)
    return lambda _, value: value.rlike(pattern)


def delete_words(df: DataFrame, columns: Sequence[str], words: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    return delete_shift(df, columns, holds_word(words), "Todas las celdas seleccionadas contienen la palabra a eliminar", "Todas las celdas seleccionadas quedaron vacías tras el borrado")


def change_report(before: DataFrame, removed: DataFrame) -> DataFrame:
    """One row: rows before, removed and left, and the share removed in hundredths of a percent."""
    n, gone = before.agg(F.count("*").alias("total_original")), removed.agg(F.count("*").alias("total_borrado"))
    both = n.join(gone)
    share = F.when(F.col("total_original") > 0, F.round(F.col("total_borrado") * 10000 / F.col("total_original")).cast("long")).otherwise(F.lit(0).cast("long"))
    return both.withColumn("total_final", F.col("total_original") - F.col("total_borrado")).withColumn("borrado_x100", share)


def compact_left(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values of the columns packed to the left; '' and nan (any case) are no values."""
    values = F.filter(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in columns]), has_value)
    packed = df.withColumn("_v", values).withColumns({c: F.coalesce(F.get("_v", F.lit(i)), F.lit("")) for i, c in enumerate(columns)})
    return packed.drop("_v")


def with_length(df: DataFrame, column: str, name: str = "Caracteres") -> DataFrame:
    """The character count of a column, first."""
    return df.select(char_count(column).cast("int").alias(name), *[F.col(f"`{c}`") for c in df.columns])


def split_by_length(df: DataFrame, column: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Rows up to the limit, and the longer ones. Null has length 0."""
    inside = char_count(column) <= limit
    return df.where(inside), df.where(~inside)


def route_by_length(df: DataFrame, column: str, limit: int) -> DataFrame:
    """All rows with ``_route`` naming their sheet."""
    return df.withColumn("_route", F.when(char_count(column) <= limit, f"Hasta_{limit}").otherwise(f"Mas_de_{limit}"))


def explode_list(df: DataFrame, column: str, separator: str = "@") -> DataFrame:
    """One row per part of a delimited list; null or '' gives one row with ''."""
    value = as_col(column)
    parts = F.when(F.coalesce(value, F.lit("")) == "", F.array(F.lit(""))).otherwise(F.split(value, f"\\Q{separator}\\E", -1))
    return df.withColumn(column, F.explode(parts))
