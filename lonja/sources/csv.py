"""CSV: reading as text with canonical headers, writing with the formula guard."""

from __future__ import annotations

import warnings
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.text import guard_formula
from lonja.operators.align import concat_diagonal, header_names
from lonja.operators.order import number_rows


#: Cells keep their outer blanks; an empty cell is written as nothing.
_WRITE = {"header": True, "escape": '"', "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def _read_one(spark: SparkSession, path: str, verbatim: bool) -> DataFrame:
    head = spark.read.option("header", False).option("multiLine", True).option("escape", '"').option("inferSchema", False).csv(path)
    first = head.limit(1).collect()
    if not first:
        return spark.createDataFrame([], "_file string, _ord long")
    cells = list(first[0])
    names = [c or "" for c in cells] if verbatim and len(set(cells)) == len(cells) and None not in cells else header_names(cells)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("enforceSchema", True)
    schema = ", ".join(f"`{n.replace('`', '``')}` string" for n in names)
    rows = reader.schema(schema).csv(path)
    # A quoted multi-line file is one task's work, so its rows keep their order within the partition.
    return rows.withColumn("_file", F.lit(path)).withColumn("_ord", F.monotonically_increasing_id())


def read_csv(spark: SparkSession, paths: Sequence[str], verbatim_headers: bool = False) -> DataFrame:
    """Text rows of all files under the union of their columns, with ``_file`` and ``_ord``.

    Short rows are filled with nulls, long ones cut. A file that cannot be read is skipped with a warning.
    """
    frames = []
    for i, path in enumerate(sorted(paths)):
        try:
            frame = _read_one(spark, path, verbatim_headers)
        except Exception as error:  # noqa: BLE001
            warnings.warn(f"{path}: {error}; skipped", stacklevel=2)
            continue
        frames.append(frame.withColumn("_ord", F.col("_ord") + F.lit(i << 48)))
    return concat_diagonal(frames)


def guarded(df: DataFrame) -> DataFrame:
    """Text cells and column names that a spreadsheet would run get an apostrophe; numbers stay."""
    cells = [(guard_formula(c) if kind == "string" else F.col(f"`{c}`")).alias("'" + c if c[:1] in ("=", "+", "-", "@") else c) for c, kind in df.dtypes]
    return df.select(*cells)


def write_csv(df: DataFrame, path: str, order: str | None = "_ord", mode: str = "errorifexists") -> None:
    """A folder of CSV parts with headers; parts follow the order."""
    ordered = df.orderBy(order) if order and order in df.columns else df
    data = guarded(ordered.select(*[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")]))
    data.write.mode(mode).options(**_WRITE).csv(path)


def write_parts(df: DataFrame, path: str, rows_each: int, order: str = "_ord", mode: str = "errorifexists") -> None:
    """Folders ``part=1``, ``part=2``, … of exactly ``rows_each`` rows in order, the last one shorter."""
    numbered = number_rows(df, [F.col(order).asc()], "_n", start=0)
    parts = numbered.withColumn("part", (F.floor(F.col("_n") / rows_each) + 1).cast("int"))
    data = guarded(parts.select("part", "_n", *[F.col(f"`{c}`") for c in df.columns if not c.startswith("_")]))
    dealt = data.repartition("part").sortWithinPartitions("part", "_n").drop("_n")
    dealt.write.mode(mode).partitionBy("part").options(**_WRITE).csv(path)


def write_routes(routes: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """One frame with ``_route``, one folder for each route."""
    frames = [f.withColumn("route", F.lit(name)) for name, f in routes.items()]
    data = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    data.write.mode(mode).partitionBy("route").parquet(path)
