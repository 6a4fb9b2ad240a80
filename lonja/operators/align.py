"""Headers, column alignment and reserved names."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lonja.functions.mojibake import repair_text
from lonja.functions.text import blank, blank_null_tokens

#: Names that operators create or use (fixed values, as the results carry them).
RESERVED = {
    "etl": ("clave_limpia", "clave_norm", "Motivo_Borrado", "_hit", "_hits", "_match", "_rank", "_ri", "_kraw", "_len", "_o_vac", "_o_grp", "_o_num", "_o_txt"),
    "builder": ("Motivo_Eliminacion", "Sku", "Precio2", "OEM3", "Combinada", "Caracteristicas", "Cantidades"),
    "validator": ("Motivo_Eliminacion", "Hoja_origen", "OEM3", "_salida", "_pid", "_prohibida", "_motivo_regla", "_cond_seg", "_preseg", "_i"),
}
RESERVED_PREFIX = "_font_color_"


def header_names(cells: Iterable[str | None]) -> list[str]:
    """Canonical names: trimmed, blank ones numbered by position, repeats numbered from 1."""
    names: list[str] = []
    for position, cell in enumerate(cells, 1):
        base = (cell or "").strip() or f"Columna_{position}"
        name, k = base, 0
        while name in names:
            k += 1
            name = f"{base}_{k}"
        names.append(name)
    return names


def union_columns(lists: Iterable[Sequence[str]]) -> list[str]:
    """All names in order of first appearance."""
    return list(dict.fromkeys(name for names in lists for name in names))


def reserved_in(columns: Iterable[str], tool: str) -> list[str]:
    return [c for c in columns if c in RESERVED[tool] or tool == "etl" and c.startswith(RESERVED_PREFIX)]


def refuse_reserved(columns: Iterable[str], tool: str) -> None:
    found = reserved_in(columns, tool)
    if found:
        raise ValueError(f"columns with reserved names: {', '.join(found)}; rename them and try again")


def text_column(df: DataFrame, name: str, missing_ok: bool = False) -> Column:
    """The column as text; a missing one is null text if allowed, else an error."""
    if name in df.columns:
        return F.col(f"`{name}`").cast("string")
    if missing_ok:
        return F.lit(None).cast("string")
    raise ValueError(f"no column {name!r}; there are {df.columns}")


def align(df: DataFrame, columns: Sequence[str], extras: bool = False, fill: str | None = None, warn: Callable[[list[str]], None] | None = None) -> DataFrame:
    """Exactly ``columns`` as text, missing ones ``fill``; further columns are kept after them or dropped with a warning."""
    more = [c for c in df.columns if c not in columns]
    if more and not extras and warn:
        warn(more)
    missing = F.lit(fill).cast("string")
    return df.select(*[(text_column(df, c) if c in df.columns else missing).alias(c) for c in columns], *([text_column(df, c).alias(c) for c in more] if extras else []))


def normalise(df: DataFrame, columns: Sequence[str], repair: bool = True) -> DataFrame:
    """Aligned text without nulls: missing columns, nulls and null words become ''."""
    aligned = align(df, columns, fill="")
    cells = {c: blank_null_tokens(repair_text(c) if repair else F.col(f"`{c}`")).alias(c) for c in columns}
    return aligned.select(*cells.values())


def fill_text(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: blank(c) for c in columns if c in df.columns})


def concat_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames of one schema, one after the other."""
    return reduce(DataFrame.unionByName, frames)


def concat_diagonal(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of columns in order of first appearance, missing cells null."""
    columns = union_columns(f.columns for f in frames)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).select(*[F.col(f"`{c}`") for c in columns])


def with_key(df: DataFrame, column: str, key: str, normaliser: Callable[[Column | str], Column]) -> DataFrame:
    """Adds the normalised key and drops rows whose key is empty."""
    return df.withColumn(key, normaliser(column)).where(F.col(key) != "")


def take_rows(df: DataFrame, positions: DataFrame, order: str = "_ord") -> DataFrame:
    """Rows of ``df`` by their order value, as often as ``positions(position, <order>)`` names them."""
    return positions.join(df, order)


def rename_brought(base: Sequence[str], brought: Sequence[str]) -> dict[str, str]:
    """New names for brought columns that clash with the base: ``c_tabla``, then ``c_tabla2`` and so on."""
    taken, names = set(base), {}
    for column in brought:
        name, k = column, 1
        while name in taken:
            name, k = f"{column}_tabla" if k == 1 else f"{column}_tabla{k}", k + 1
        taken.add(name)
        names[column] = name
    return names
