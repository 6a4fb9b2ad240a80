"""Image URL expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lonja.functions.text import as_col, blank, trim_space

#: Extensions of an image path (fixed values).
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "webp", "bmp", "tiff", "gif")
_URL = r"(?i:https?)://[^\s,;]+"


def is_image_url(value: Column | str) -> Column:
    """An http(s) URL whose path, before any query, ends in an image extension."""
    text = trim_space(blank(value))
    path = F.lower(F.substring_index(text, "?", 1))
    return F.lower(text).rlike("^https?://") & path.rlike(f"[.]({'|'.join(IMAGE_EXTENSIONS)})\\z")


def image_urls(value: Column | str) -> Column:
    """The image URLs of a cell, in order."""
    return F.filter(F.regexp_extract_all(blank(value), F.lit(f"({_URL})"), 1), is_image_url)


def listing_image(value: Column | str) -> Column:
    """The first URL with its last path segment replaced by the large rendition; a video or no URL gives ''."""
    text = blank(value)
    url = F.regexp_extract(text, '(https?[^\\s"]+)', 1)
    return F.when(text.rlike("(?iu)video"), F.lit("")).otherwise(F.regexp_replace(url, "/[^/]*\\z", "/s-l1600.jpg"))


def variant_image(value: Column | str) -> Column:
    """The first size variant of a URL replaced by the large one."""
    return F.regexp_replace(blank(value), "^(.*?)[.]_AC_.*?_[.]", "$1._AC_SL1500_.")


def item_id(url: Column | str) -> Column:
    """The number that ends the path of a listing URL."""
    return F.regexp_extract(blank(url), r"/(\d+)(?:\?|\z)", 1)


def product_id(url: Column | str) -> Column:
    """The identifier after ``/dp/``."""
    return F.regexp_extract(blank(url), r"/dp/([A-Z0-9]+)(?:[/?]|\z)", 1)


def cut_reference(url: Column | str) -> Column:
    return F.regexp_replace(blank(url), r"/ref=.*\z", "")


def has_value(value: Column | str) -> Column:
    return ~F.lower(trim_space(blank(as_col(value)))).isin("", "nan")
