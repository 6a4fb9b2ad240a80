"""Combining many files: align, normalise, optional spreadsheet sort, optional division."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.functions.mojibake import repair_text
from lonja.operators.align import concat_rows, normalise, union_columns
from lonja.operators.order import number_rows, sheet_order


class Division(Enum):
    NONE = "none"
    SHEETS = "sheets"
    FILES = "files"


@dataclass(frozen=True)
class CombineOptions:
    columns: Sequence[str] | None = None
    sort_column: str | None = None
    ascending: bool = True
    division: Division = Division.NONE
    rows_each: int = 1_000_000
    fmt: str = "xlsx"
    repair: bool = True


#: Device names that a file may not have on some systems (fixed values).
_DEVICES = {"con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))}


def check_output_name(name: str) -> str:
    """The name, or an error if it would leave its folder or name a device."""
    if not name.strip() or name in (".", "..") or re.search(r'[/\\:*?"<>|\x00-\x1f]', name) or name.split(".")[0].strip().lower() in _DEVICES:
        raise ValueError(f"not a file name: {name!r}")
    return name


def combine(frames: Sequence[DataFrame], options: CombineOptions = CombineOptions()) -> DataFrame:
    """All rows as text under the chosen columns (default: the union in order of appearance), with ``_file`` and ``_ord``.

    ``frames`` carry ``_ord``, unique within each. With a division the result has ``_part``, counted from 1.
    """
    if options.division is Division.SHEETS and options.fmt == "csv":
        raise ValueError("a CSV file has no sheets to divide into")
    if options.rows_each < 1:
        raise ValueError("rows_each must be positive")
    columns = list(options.columns or union_columns([c for c in f.columns if c != "_ord"] for f in frames))
    if options.sort_column is not None and options.sort_column not in columns:
        raise ValueError(f"no column {options.sort_column!r} to sort by")
    parts = []
    for i, frame in enumerate(frames):
        kept = normalise(frame.withColumn("_ord", F.col("_ord").cast("string")), [*columns, "_ord"], repair=False)
        parts.append(kept.withColumn("_ord", F.col("_ord").cast("long")).withColumn("_file", F.lit(i)))
    rows = concat_rows(parts)
    if options.repair:
        rows = rows.withColumns({c: repair_text(c) for c in columns})
    keys = [*(sheet_order(options.sort_column, options.ascending) if options.sort_column else []), F.col("_file").asc(), F.col("_ord").asc()]
    if options.division is Division.NONE:
        return rows.orderBy(*keys) if options.sort_column else rows
    numbered = number_rows(rows, keys, "_n", start=0)
    return numbered.withColumn("_part", (F.floor(F.col("_n") / options.rows_each) + 1).cast("int")).drop("_n")
