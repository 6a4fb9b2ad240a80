"""Image cells: URL columns, pending tasks, verdicts and how they return to the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.text import blank
from lonja.functions.urls import has_value, image_urls, is_image_url
from lonja.operators.rows import compact_left


def url_columns(df: DataFrame, sample: int = 1000, order: str = "_ord") -> list[str]:
    """Text columns of which a sample of rows holds image URLs in three of ten cells at least, one at least.

    The sample is the first ``sample`` non-null values of each column; one aggregate reads them all.
    """
    names = [c for c, kind in df.dtypes if kind == "string" and not c.startswith("_")]
    head = df.orderBy(order).limit(sample) if order in df.columns else df.limit(sample)
    row = head.agg(F.count("*").alias("n"), *[F.count_if(is_image_url(c)).alias(f"h{i}") for i, c in enumerate(names)]).first()
    least = max(1, int(row["n"] * 0.3))
    return [c for i, c in enumerate(names) if row["n"] and row[f"h{i}"] >= least]


def filled_url_columns(df: DataFrame, sample: int = 10_000) -> list[str]:
    """As above, over the non-blank cells seen."""
    names = [c for c, kind in df.dtypes if kind == "string" and not c.startswith("_")]
    seen = [F.count_if(blank(c) != "") for c in names]
    row = df.limit(sample).agg(*[s.alias(f"n{i}") for i, s in enumerate(seen)], *[F.count_if(F.size(image_urls(c)) > 0).alias(f"h{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"n{i}"] and row[f"h{i}"] >= max(1, int(row[f"n{i}"] * 0.3))]


def cells(df: DataFrame, columns: Sequence[str], order: str = "_ord") -> DataFrame:
    """Long form ``(idx, col, url)`` of the image cells."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), F.col(f"`{c}`").cast("string").alias("url")) for c in columns])
    return df.select(F.col(order).cast("long").alias("idx"), F.explode(pairs).alias("c")).select("idx", "c.col", "c.url").where(is_image_url("url"))


def pending(df: DataFrame, columns: Sequence[str], done: DataFrame, order: str = "_ord") -> DataFrame:
    """Image cells without a verdict in ``done(idx, col, …)``."""
    return cells(df, columns, order).join(done, ["idx", "col"], "left_anti")


def embed_tasks(df: DataFrame, columns: Sequence[str], order: str = "_ord") -> DataFrame:
    """``(idx, col, slot, url)``: every URL of a cell with its place among the columns inserted for it."""
    pairs = F.array(*[F.struct(F.lit(c).alias("col"), image_urls(c).alias("urls")) for c in columns])
    return df.select(F.col(order).cast("long").alias("idx"), F.explode(pairs).alias("c")).select("idx", "c.col", F.posexplode("c.urls").alias("slot", "url"))


def embed_layout(tasks: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(col, original, k, final)``: columns inserted right of each URL column, and where it ends up."""
    widths = tasks.groupBy("col").agg((F.max("slot") + 1).alias("k"))
    places = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (c, i)])
    placed = widths.withColumn("original", places[F.col("col")])
    earlier = placed.select(F.col("original").alias("o"), F.col("k").alias("w"))
    before = placed.join(earlier, F.col("o") < F.col("original"), "left").groupBy("col", "original", "k").agg(F.coalesce(F.sum("w"), F.lit(0)).alias("b"))
    return before.select("col", "original", "k", (F.col("original") + F.col("b")).cast("int").alias("final"))


def apply_verdicts(df: DataFrame, columns: Sequence[str], verdicts: DataFrame, order: str = "_ord") -> DataFrame:
    """Rejected URLs blanked, ``_<col>_aprobada`` and ``_<col>_motivo``, and the row's flags and joined reasons.

    ``verdicts(idx, col, approved, reason)``; cells without one count as approved.
    """
    wide = verdicts.where(F.col("col").isin(list(columns))).groupBy("idx").agg(F.map_from_entries(F.collect_list(F.struct("col", F.struct("approved", "reason")))).alias("_v"))
    joined = df.join(wide, F.col(order) == F.col("idx"), "left").drop("idx")

    def verdict(c: str, field: str, default: object) -> Column:
        return F.coalesce(F.try_element_at(F.col("_v"), F.lit(c))[field], F.lit(default))

    flags = {f"_{c}_aprobada": verdict(c, "approved", True) for c in columns} | {f"_{c}_motivo": verdict(c, "reason", "") for c in columns}
    out = joined.withColumns(flags)
    out = out.withColumns({c: F.when(F.col(f"`_{c}_aprobada`"), blank(c)).otherwise("") for c in columns})
    approved = F.array(*[F.col(f"`_{c}_aprobada`") for c in columns])
    reasons = F.filter(F.array(*[F.when(F.col(f"`_{c}_motivo`") != "", F.concat(F.lit(f"[{c}] "), F.col(f"`_{c}_motivo`"))) for c in columns]), lambda r: r.isNotNull())
    return out.withColumns({"_imagen_aprobada": F.exists(approved, lambda a: a), "_tiene_rechazada": F.exists(approved, lambda a: ~a), "_imagen_motivo": F.array_join(reasons, " | ")}).drop("_v")


def approved_rows(result: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows with any approved image, URLs packed to the left."""
    return compact_left(result.where("_imagen_aprobada"), columns)


def rejected_rows(result: DataFrame, original: DataFrame, columns: Sequence[str], rejected_only: bool = False, order: str = "_ord") -> DataFrame:
    """Rows with any rejected image and ``Motivo_Rechazo``.

    With all their original images, or with the rejected ones alone, packed to the left and reasons renumbered.
    """
    source = original.select(F.col(order).alias("_o"), *[F.col(f"`{c}`").alias(f"_s_{i}") for i, c in enumerate(columns)])
    rows = result.where("_tiene_rechazada").join(source, F.col(order) == F.col("_o")).drop("_o")
    if not rejected_only:
        shown = rows.withColumns({c: F.col(f"_s_{i}") for i, c in enumerate(columns)}).drop(*[f"_s_{i}" for i in range(len(columns))])
        return shown.withColumnRenamed("_imagen_motivo", "Motivo_Rechazo")
    kept = {c: F.when(F.col(f"`_{c}_aprobada`"), "").otherwise(blank(f"_s_{i}")) for i, c in enumerate(columns)}
    rows = rows.withColumns(kept).drop(*[f"_s_{i}" for i in range(len(columns))])
    shown = F.filter(F.array(*[F.struct(F.col(f"`{c}`").alias("u"), F.col(f"`_{c}_motivo`").alias("m")) for c in columns]), lambda x: has_value(x["u"]))
    reason = F.array_join(F.transform(shown, lambda x, i: F.rtrim(F.concat(F.lit("[Imagen "), (i + 1).cast("string"), F.lit("] "), x["m"]))), " | ")
    return compact_left(rows.withColumn("Motivo_Rechazo", reason), columns).drop("_imagen_motivo")


def verdict_counts(verdicts: DataFrame) -> DataFrame:
    return verdicts.agg(F.count("*").alias("analizadas"), F.count_if(~F.col("approved")).alias("rechazadas"))
