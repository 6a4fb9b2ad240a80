"""One function for each tool mode: read workbooks or CSV, run the operator, write the routes.

``python -m lonja.tools MODE --in FILE... --out PATH [--option value]`` runs a mode from the command line; the options are
the function's keyword arguments.
"""

from __future__ import annotations

import argparse
import inspect
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.operators import align, cells, dups, lookup, order, rows
from lonja.operators.lookup import Several
from lonja.plans import combine as combining
from lonja.plans import images as judging
from lonja.plans import listing, titles
from lonja.sources.csv import read_csv, write_csv
from lonja.sources.fetch import FetchOptions
from lonja.sources.xlsx import read_xlsx, write_xlsx

MODES: dict[str, Callable[..., dict[str, DataFrame]]] = {}


def mode(run: Callable[..., dict[str, DataFrame]]) -> Callable[..., dict[str, DataFrame]]:
    MODES[run.__name__] = run
    return run


def read(spark: SparkSession, paths: Sequence[str], exclude: Sequence[str] = ()) -> DataFrame:
    """Workbooks or CSV files, by extension."""
    if all(p.lower().endswith(".csv") for p in paths):
        return read_csv(spark, paths)
    return read_xlsx(spark, list(paths), exclude)


def write(routes: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each route, or a folder of CSV files for each."""
    if path.lower().endswith(".xlsx"):
        write_xlsx(routes, path)
        return
    for name, frame in routes.items():
        write_csv(frame, f"{path}/{name}")


def _etl(df: DataFrame) -> DataFrame:
    align.refuse_reserved([c for c in df.columns if c not in ("_ord", "_file", "_sheet")], "etl")
    return df


@mode
def combine(spark: SparkSession, inputs: Sequence[str], sort: str | None = None, descending: bool = False, exclude: Sequence[str] = ()) -> dict[str, DataFrame]:
    frames = [read(spark, [p], exclude).drop("_file", "_sheet") for p in inputs]
    return {"Hoja1": combining.combine(frames, combining.CombineOptions(sort_column=sort, ascending=not descending))}


@mode
def vlookup(spark: SparkSession, inputs: Sequence[str], key: str, table: str, table_key: str, bring: Sequence[str], every: bool = False, matched_only: bool = False) -> dict[str, DataFrame]:
    found = lookup.exact_table(read(spark, [table]), table_key, bring, every=every)
    return {"Hoja1": lookup.exact_lookup(_etl(read(spark, inputs)), key, found, matched_only)}


@mode
def vlookup_words(spark: SparkSession, inputs: Sequence[str], key: str, table: str, table_key: str, bring: Sequence[str], several: str = "longest", matched_only: bool = False) -> dict[str, DataFrame]:
    found = lookup.phrase_table(read(spark, [table]), table_key, bring, every=several == "all")
    return {"Hoja1": lookup.phrase_lookup(_etl(read(spark, inputs)), key, found, Several(several), matched_only=matched_only)}


@mode
def find(spark: SparkSession, inputs: Sequence[str], column: str, words: Sequence[str], every: bool = False) -> dict[str, DataFrame]:
    listed = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "word string, _ord long")
    found = lookup.word_table(listed, "word")
    return {"Hoja1": lookup.find_words(_etl(read(spark, inputs)), column, found, Several.ALL if every else Several.FIRST)}


@mode
def duplicates(spark: SparkSession, inputs: Sequence[str], column: str) -> dict[str, DataFrame]:
    df = _etl(read(spark, inputs))
    return {"Duplicados": dups.duplicate_report(df, column), "Limpio": dups.without_duplicates(df, column)}


@mode
def compare(spark: SparkSession, inputs: Sequence[str], column: str, other: str, other_column: str) -> dict[str, DataFrame]:
    df, against = _etl(read(spark, inputs)), read(spark, [other])
    return {"Duplicados": dups.rows_with_key_in(df, column, against, other_column), "Limpio": dups.rows_with_key_in(df, column, against, other_column, inside=False)}


@mode
def delete_words(spark: SparkSession, inputs: Sequence[str], columns: Sequence[str], words: Sequence[str]) -> dict[str, DataFrame]:
    kept, gone = rows.delete_words(_etl(read(spark, inputs)), columns, words)
    return {"Procesadas": kept, "Borradas": gone}


@mode
def sort(spark: SparkSession, inputs: Sequence[str], column: str, descending: bool = False) -> dict[str, DataFrame]:
    return {"Hoja1": order.sort_sheet(_etl(read(spark, inputs)), column, not descending).drop("_ord")}


@mode
def lengths(spark: SparkSession, inputs: Sequence[str], column: str, limit: int | None = None, descending: bool = False) -> dict[str, DataFrame]:
    """With a limit the two sheets, without one the count as first column in order of length."""
    df = _etl(read(spark, inputs))
    if limit is None:
        return {"Hoja1": order.sort_by_length(rows.with_length(df, column), column, not descending).drop("_ord")}
    inside, outside = rows.split_by_length(df, column, limit)
    return {f"Hasta_{limit}": inside, f"Mas_de_{limit}": outside}


def _brackets(path: str) -> list[listing.Bracket]:
    with open(path, encoding="utf-8") as lines:
        return listing.read_brackets(list(lines))


@mode
def unique(spark: SparkSession, inputs: Sequence[str], brackets: str, change_oem: bool = False) -> dict[str, DataFrame]:
    return listing.unique_listings(read(spark, inputs), _brackets(brackets), change_oem)


@mode
def marketplace(spark: SparkSession, inputs: Sequence[str], brackets: str, change_oem: bool = False, first_image_only: bool = False) -> dict[str, DataFrame]:
    return listing.marketplace_listings(read(spark, inputs), _brackets(brackets), change_oem, first_image_only)


@mode
def compatibility(spark: SparkSession, inputs: Sequence[str], brackets: str, compressed: bool = False, change_oem: bool = False, drop_line: bool = False) -> dict[str, DataFrame]:
    book = read_xlsx(spark, list(inputs))
    products = book.where(F.lower(F.trim("_sheet")) == "hoja1").drop("_file", "_sheet")
    sheets = book.where(listing.is_compatibility_sheet("_sheet")).drop("_file", "_sheet")

    def used(df: DataFrame) -> DataFrame:
        """Without the columns that only the other sheets have."""
        names = [c for c in df.columns if c != "_ord"]
        seen = df.agg(*[F.count(f"`{c}`").alias(c) for c in names]).first()
        return df.select(*[F.col(f"`{c}`") for c in names if seen[c]], "_ord")

    kind = listing.Mode.COMPRESSED if compressed else listing.Mode.REPEATED
    return listing.compatibility(used(products), used(sheets), _brackets(brackets), kind, change_oem, drop_line)


@mode
def validate(spark: SparkSession, inputs: Sequence[str], brands: Sequence[str] = (), critical: Sequence[str] = (), forbidden: Sequence[str] = (), change_oem: bool = False) -> dict[str, DataFrame]:
    return titles.validate(read(spark, inputs), titles.Vocabulary(brands, critical, forbidden), change_oem=change_oem)


@mode
def images(spark: SparkSession, inputs: Sequence[str], store: str, columns: Sequence[str] = (), rejected_only: bool = False, batches: int = 16, allow_private: bool = False) -> dict[str, DataFrame]:
    """Rows by the verdicts on their images (pixel rules); a second run with the same store judges only what is left."""
    df = read(spark, inputs)
    named = list(columns) or cells.url_columns(df)
    if not named:
        raise ValueError("no column holds image URLs")
    verdicts = judging.resume(df, named, store, batches, FetchOptions(allow_private=allow_private))
    result = cells.apply_verdicts(df, named, verdicts)
    return {"Aprobadas": cells.approved_rows(result, named), "Rechazadas": cells.rejected_rows(result, df, named, rejected_only)}


def main(arguments: Sequence[str] | None = None) -> None:
    from lonja.session import local_session

    parser = argparse.ArgumentParser(description=__doc__)
    modes = parser.add_subparsers(dest="mode", required=True)
    for name, run in MODES.items():
        own = modes.add_parser(name)
        own.add_argument("--in", dest="inputs", nargs="+", required=True)
        own.add_argument("--out", required=True)
        for option, about in list(inspect.signature(run).parameters.items())[2:]:
            shown, kind = f"--{option.replace('_', '-')}", str(about.annotation)
            needed = about.default is inspect.Parameter.empty
            if kind == "bool":
                own.add_argument(shown, dest=option, action="store_true")
            elif kind.startswith("Sequence"):
                own.add_argument(shown, dest=option, nargs="+", required=needed, default=() if needed else about.default)
            else:
                own.add_argument(shown, dest=option, required=needed, default=None if needed else about.default, type=int if kind.startswith("int") else str)
    chosen = vars(parser.parse_args(arguments))
    name, out = chosen.pop("mode"), chosen.pop("out")
    write(MODES[name](local_session(), **chosen), out)


if __name__ == "__main__":
    main()
