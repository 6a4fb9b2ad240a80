"""Listing pipelines: prices, SKUs, features, part numbers, images, and the product by compatibility join.

Input rows are text with an order column ``_ord`` (unique, in reading order). Every pipeline returns its routes, a frame
for each output sheet.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.functions.text import as_col, bind, blank, capitalise, collapse_space, dollar_price, first_digits, trim_space
from lonja.functions.urls import cut_reference, item_id, listing_image, product_id, variant_image
from lonja.operators.align import refuse_reserved
from lonja.operators.dups import keep_cheapest
from lonja.operators.rows import explode_list, split_by_reason

# Column names, motives, default part number and word maps are fixed values: results carry them.
URL, PRICE, OPTION, TITLE, STORE, OEM = "web-scraper-start-url", "Precio", "Opcion", "Titulo", "Tienda", "OEM"
IMAGES = ("Imagen 1", "Imagen 2", "Imagen 3", "Imagen 4")
DEFAULT_OEM, OEM_LENGTH = "US123400", 250
HAS_OPTION, NO_IMAGES, ZERO_PRICE = "Tiene contenido en Opcion", "Sin imágenes", "Precio es 0"
FEATURES = {
    "front": "frontal", "rear": "trasero", "lh": "izq", "left": "izq", "driver": "izq", "rh": "der",
    "right": "der", "passenger": "der", "intake": "admision", "exhaust": "escape", "upper": "superior", "lower": "inferior",
}
OPPOSITES = (("frontal", "trasero"), ("izq", "der"), ("admision", "escape"), ("superior", "inferior"))
QUANTITIES = {"kit": "kit", "pair": "par", "set": "set", "pcs": "set"}


@dataclass(frozen=True)
class Bracket:
    """Inclusive price range and its list price."""

    low: int
    high: int
    price: int


def read_brackets(lines: Sequence[str]) -> list[Bracket]:
    """``low,high,price`` a line; blank lines and those that begin with # are skipped, anything else is an error."""
    return [Bracket(*map(int, line.split(","))) for line in map(str.strip, lines) if line and not line.startswith("#")]


def bracket_price(price: Column, brackets: Sequence[Bracket]) -> Column:
    """The list price of the first bracket that holds the price, else null."""
    found = F.lit(None).cast("bigint")
    for b in reversed(brackets):
        found = F.when(price.between(b.low, b.high), F.lit(b.price).cast("bigint")).otherwise(found)
    return found


def jitter(index: Column) -> Column:
    """1 to 50, from the row's index by a multiplicative hash."""
    return F.pmod(F.pmod(index.cast("bigint") * F.lit(2654435761), F.lit(4294967296)), F.lit(50)) + 1


def list_price(price: Column, brackets: Sequence[Bracket], index: Column) -> Column:
    return bracket_price(price, brackets) - jitter(index)


def _tokens(title: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(blank(title)), F.lit(r"(?U)(\b\w+\b)"), 1)


def features(title: Column | str) -> Column:
    """Mapped words in order, once each, opposite pairs cancelled, capitalised, with a blank at the end if any."""
    mapping = F.create_map(*[F.lit(x) for pair in FEATURES.items() for x in pair])
    opposite = F.create_map(*[F.lit(x) for a, b in OPPOSITES for x in (a, b, b, a)])
    found = F.array_distinct(F.filter(F.transform(_tokens(title), lambda t: F.try_element_at(mapping, t)), lambda v: v.isNotNull()))
    kept = bind(found, lambda all_of: F.filter(all_of, lambda v: ~F.coalesce(F.array_contains(all_of, F.try_element_at(opposite, v)), F.lit(False))))
    return F.array_join(F.transform(kept, lambda v: F.concat(capitalise(v), F.lit(" "))), "")


def quantity(title: Column | str) -> Column:
    """Kit before pair before set or pcs."""

    def first(words: Column) -> Column:
        found = F.lit("")
        for word, value in reversed(QUANTITIES.items()):
            found = F.when(F.array_contains(words, word), value.capitalize()).otherwise(found)
        return found

    return bind(_tokens(title), first)


def with_features(df: DataFrame) -> DataFrame:
    if TITLE not in df.columns:
        return df
    return df.withColumns({"Caracteristicas": features(TITLE), "Cantidades": quantity(TITLE)})


def with_oem3(df: DataFrame) -> DataFrame:
    """Null part numbers get the default; ``OEM3`` is the first 250 characters, the default where it is blank."""
    if OEM not in df.columns:
        return df
    oem = F.coalesce(F.col(OEM).cast("string"), F.lit(DEFAULT_OEM))
    short = F.when(trim_space(oem) == "", F.lit(DEFAULT_OEM)).otherwise(F.substring(oem, 1, OEM_LENGTH))
    return df.withColumns({OEM: oem, "OEM3": short})


def sku(price: Column | str, store: Column | str, identifier: Column, visit: bool = False) -> Column:
    """``u-price-store-identifier``; the store lower-cased without blanks and marks, its ``visit the`` cut if asked."""
    name = F.lower(blank(store))
    if visit:
        name = F.regexp_replace(name, r"(?U)^visit\s+the\s*", "")
    name = F.regexp_replace(name, r"(?U)[\s:_\-.,*/\\]", "")
    return F.concat(F.lit("u-"), F.coalesce(as_col(price).cast("string"), F.lit("0")), F.lit("-"), name, F.lit("-"), identifier)


def with_sku(df: DataFrame, identifier: Column | None = None, visit: bool = False) -> DataFrame:
    if not {PRICE, STORE, URL} <= set(df.columns):
        return df
    return df.withColumn("Sku", sku(PRICE, STORE, item_id(URL) if identifier is None else identifier, visit))


def no_images(df: DataFrame, video_too: bool = False, without_columns: bool = True) -> Column:
    """True if every image column is empty; ``without_columns`` is the answer where there are none."""
    present = [c for c in IMAGES if c in df.columns]
    if not present:
        return F.lit(without_columns)
    return F.forall(F.array(*[blank(c) for c in present]), lambda v: (v == "") | (v.rlike("(?iu)video") if video_too else F.lit(False)))


def has_option(df: DataFrame) -> Column:
    return blank(OPTION) != "" if OPTION in df.columns else F.lit(False)


def common_steps(df: DataFrame, change_oem: bool = False) -> DataFrame:
    """Images, part numbers if asked, SKU."""
    df = df.withColumns({c: listing_image(c) for c in IMAGES if c in df.columns})
    return with_sku(with_oem3(df) if change_oem else df)


def _priced(df: DataFrame, brackets: Sequence[Bracket], price: Column, order: str) -> DataFrame:
    if PRICE not in df.columns:
        return df
    return df.withColumn(PRICE, price).withColumn("Precio2", list_price(F.col(PRICE), brackets, F.col(order)))


def unique_listings(df: DataFrame, brackets: Sequence[Bracket], change_oem: bool = False, order: str = "_ord") -> dict[str, DataFrame]:
    """Routes ``Hoja1`` and ``Eliminadas`` of a scrape of single listings."""
    refuse_reserved(df.columns, "builder")
    rows = _priced(df.drop("web-scraper-order"), brackets, first_digits(PRICE) if PRICE in df.columns else F.lit(None), order)
    rows = with_features(common_steps(rows, change_oem))
    valid, removed = split_by_reason(rows, [(has_option(rows), HAS_OPTION), (no_images(rows), NO_IMAGES)])
    return {"Hoja1": valid.drop(PRICE, OPTION, "Caracteristicas", "Cantidades"), "Eliminadas": removed}


def marketplace_listings(df: DataFrame, brackets: Sequence[Bracket], change_oem: bool = False, first_image_only: bool = False, order: str = "_ord") -> dict[str, DataFrame]:
    """Routes ``Hoja1`` and ``Eliminadas`` of a marketplace scrape with product links."""
    for i in range(1, 5):
        if f"Imagen {i}-src" in df.columns and f"Imagen {i}" not in df.columns:
            df = df.withColumnRenamed(f"Imagen {i}-src", f"Imagen {i}")
    refuse_reserved(df.columns, "builder")
    rows = df.drop("pagination", "product-link", URL, "web-scraper-order").withColumnRenamed("product-link-href", URL)
    if URL in rows.columns:
        rows = rows.withColumn(URL, cut_reference(URL))
    rows = _priced(rows, brackets, first_digits(PRICE) if PRICE in rows.columns else F.lit(None), order)
    images = {c: F.lit("") if first_image_only and c != IMAGES[0] else variant_image(c) for c in IMAGES if c in rows.columns}
    rows = with_sku(rows.withColumns(images) if images else rows, product_id(URL) if URL in rows.columns else None, visit=True)
    rows = with_oem3(rows) if change_oem else rows
    zero = F.coalesce(F.col(PRICE) == 0, F.lit(False)) if PRICE in rows.columns else F.lit(False)
    valid, removed = split_by_reason(rows, [(has_option(rows), HAS_OPTION), (no_images(rows), NO_IMAGES), (zero, ZERO_PRICE)])
    return {"Hoja1": valid.drop(OPTION, PRICE), "Eliminadas": removed}


class Mode(Enum):
    """One row per vehicle, or a delimited list of vehicles per row."""

    REPEATED = "repetidas"
    COMPRESSED = "comprimidas"


def split_products(df: DataFrame, brackets: Sequence[Bracket], order: str = "_ord") -> tuple[DataFrame, DataFrame]:
    """Products with a dollar price read; those with an option or without images (a video is none) are set apart."""
    rows = _priced(df, brackets, dollar_price(PRICE) if PRICE in df.columns else F.lit(None), order)
    drop = has_option(rows) | no_images(rows, video_too=True, without_columns=False)
    return rows.where(~drop), rows.where(drop)


def clean_compatibility(df: DataFrame, mode: Mode, drop_line: bool = False) -> DataFrame:
    """All text; in repeated mode double hyphens leave the line column, or the column goes and its litres leave the model."""
    df = df.select(*[F.col(f"`{c}`").cast("string").alias(c) if c != "_ord" else F.col(c) for c in df.columns])
    if mode is not Mode.REPEATED:
        return df
    line = next((c for c in df.columns if c.strip().lower() == "linea"), None)
    if line and not drop_line:
        return df.withColumn(line, F.replace(blank(line), F.lit("--"), F.lit("")))
    df = df.drop(line) if line else df
    if drop_line and "Modelo" in df.columns:
        df = df.withColumn("Modelo", trim_space(F.regexp_replace(blank("Modelo"), r"(?U)\s*\b\d\.\d[T]?\b\s*", " ")))
    return df


def combined_columns(mode: Mode, drop_line: bool = False) -> list[str]:
    head = ["Cantidades", "Traducido", "Caracteristicas"]
    if mode is Mode.COMPRESSED:
        return [*head, "Coincidencia"]
    return [*head, "Marca", "Chasis", "Modelo", *([] if drop_line else ["Linea"]), "Litros"]


def combined(columns: Sequence[str]) -> Column:
    """Parts without a final ``.0``, trimmed, joined by single blanks."""
    parts = [trim_space(F.regexp_replace(blank(c), r"\.0\z", "")) for c in columns]
    return collapse_space(F.concat_ws(" ", *parts)) if parts else F.lit("")


def numbered_sku(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """``base-N``: N counts the rows of the base in order."""
    if "Sku" not in df.columns:
        return df
    number = F.row_number().over(Window.partitionBy("Sku").orderBy(*order))
    return df.withColumn("_n", number).withColumn("Sku", F.concat_ws("-", blank("Sku"), F.col("_n").cast("string"))).drop("_n")


def clean_hyphens(text: Column | str) -> Column:
    """A final ``-NA`` goes; hyphens stay between digits and become blanks elsewhere."""
    text = F.regexp_replace(as_col(text), r"-NA\z", "")
    text = F.regexp_replace(text, r"(?U)(\d)-(\d)", "$1@@HYPHEN@@$2")
    return F.replace(F.replace(text, F.lit("-"), F.lit(" ")), F.lit("@@HYPHEN@@"), F.lit("-"))


def derive(df: DataFrame, columns: Sequence[str], change_oem: bool, order: Sequence[str]) -> DataFrame:
    """Features, common steps, numbered SKU, first token of the litres, and ``Combinada``."""
    rows = numbered_sku(common_steps(with_features(df), change_oem), order)
    if "Litros" in rows.columns:
        rows = rows.withColumn("Litros", F.regexp_extract(trim_space(blank("Litros")), r"(?U)^(\S+)", 1))
    return rows.withColumn("Combinada", combined([c for c in columns if c in rows.columns]))


def route_combined(df: DataFrame, mode: Mode) -> DataFrame:
    """``_route`` by length, errors and missing parts of ``Combinada``; hyphens cleaned in what is left."""
    text = blank("Combinada")
    route = F.when(F.char_length(text) > 60, "Exceso_caracteres")
    if mode is Mode.COMPRESSED:
        route = route.when(F.contains(text, F.lit("ERROR")) | (F.regexp_count(text, F.lit("NA")) >= 2), "Eliminadas")
    routed = df.withColumn("_route", route.otherwise("Procesadas"))
    if mode is Mode.COMPRESSED:
        routed = routed.withColumn("Combinada", F.when(F.col("_route") == "Procesadas", clean_hyphens(text)).otherwise(text))
    return routed


def compatibility(products: DataFrame, sheets: DataFrame, brackets: Sequence[Bracket], mode: Mode, change_oem: bool = False, drop_line: bool = False) -> dict[str, DataFrame]:
    """Joins products with compatibility rows on the scraped URL.

    Routes: ``Procesadas`` (the cheapest row of each ``Combinada``), ``No_Procesadas`` (products without a row, rows with
    a blank list), ``Exceso_caracteres``, ``Eliminadas`` (with the reason), ``Duplicadas`` (dearer rows of a title, which
    would otherwise vanish). Where both sides have a column, the compatibility value shows, in the product's place.
    """
    refuse_reserved(products.columns, "builder")
    refuse_reserved(sheets.columns, "builder")
    kept, dropped = split_products(products, brackets)
    columns = combined_columns(mode, drop_line)
    removed = dropped.withColumn("Motivo", F.lit("Producto descartado"))
    if URL not in kept.columns:
        return {"No_Procesadas": derive(kept, columns, change_oem, ["_ord"]).drop(PRICE), "Eliminadas": removed}
    side = clean_compatibility(sheets, mode, drop_line)
    data = [c for c in side.columns if c != "_ord"]
    side = side.groupBy(*[F.col(f"`{c}`") for c in data]).agg(F.min("_ord").alias("_ord2"))
    clash = [c for c in data if c in kept.columns and c != URL]
    joined = kept.drop(*clash).join(side, URL)
    own = [c for c in kept.columns if c != "_ord"]
    rows = joined.select(*[F.col(f"`{c}`") for c in [*own, *[c for c in data if c not in own], "_ord", "_ord2"]])
    if mode is Mode.COMPRESSED and "Coincidencia" in rows.columns:
        rows = explode_list(rows, "Coincidencia")
    derived = derive(rows, columns, change_oem, ["_ord2", "_ord", *(["Coincidencia"] if "Coincidencia" in rows.columns else [])])
    routed = route_combined(derived, mode)
    if "Coincidencia" in routed.columns:
        routed = routed.withColumn("_route", F.when(trim_space(blank("Coincidencia")) == "", "No_Procesadas").otherwise(F.col("_route")))
    unmatched = derive(kept.join(sheets.select(URL).distinct(), URL, "left_anti"), columns, change_oem, ["_ord"])

    def route(name: str) -> DataFrame:
        return routed.where(F.col("_route") == name).drop("_route", *([] if name == "Eliminadas" else [PRICE]))

    ready = route("Procesadas")
    if "Precio2" in ready.columns:
        numbered = ready.withColumn("_o", F.struct("_ord2", "_ord", "Sku") if "Sku" in ready.columns else F.struct("_ord2", "_ord"))
        ready, dearer = (f.drop("_o") for f in keep_cheapest(numbered, "Combinada", "Precio2", "_o"))
    else:
        dearer = ready.where(F.lit(False))
    bad = route("Eliminadas").withColumn("Motivo", F.lit("Combinada con ERROR o dos NA"))
    return {
        "Procesadas": ready,
        "No_Procesadas": unmatched.drop(PRICE).unionByName(route("No_Procesadas"), allowMissingColumns=True),
        "Exceso_caracteres": route("Exceso_caracteres"),
        "Eliminadas": removed.unionByName(bad, allowMissingColumns=True),
        "Duplicadas": dearer,
    }


def is_compatibility_sheet(name: Column | str) -> Column:
    """A sheet called hoja and digits, any case, but not the product sheet."""
    trimmed = F.lower(trim_space(as_col(name)))
    return trimmed.rlike("^hoja[0-9]+\\z") & (trimmed != "hoja1")
