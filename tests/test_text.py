import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lonja.functions import text, urls
from lonja.functions.mojibake import damage, repair, repair_text

NASTY = ["", " ", " x ", "\x1cx\x1c", "5.", "+34", "1e5", "007", "1,000", "1_000", "0x10", "nan", "inf", "1d", "1e999", "-.5", ".", "Niño ÁÉÍÓÚÜ àçö", "a\tb", None]


def column(spark, values, expression, name="v"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def fold(v):
    return (v or "").lower().translate(str.maketrans("áéíóúü", "aeiouu"))


def test_keys(spark):
    assert column(spark, NASTY, text.clean_key("v")) == [re.sub("[^0-9a-zñ]", "", fold(v)) for v in NASTY]
    assert column(spark, NASTY, text.phrase_key("v")) == [re.sub("[^0-9a-zñ]+", " ", fold(v)).strip(" ") for v in NASTY]


def test_numbers_are_finite_decimals_alone(spark):
    found = dict(zip(NASTY, column(spark, NASTY, text.finite_number("v")), strict=True))
    assert {k: v for k, v in found.items() if v is not None} == {"5.": 5, "+34": 34, "1e5": 1e5, "007": 7, "-.5": -0.5}


def test_trim_takes_white_space_but_not_separators(spark):
    assert column(spark, [" x ", "\x1cx\x1c", "　a b\n"], text.trim_space("v")) == ["x", "\x1cx\x1c", "a b"]


def test_prices(spark):
    values = ["$1,234.56", "US $85.99", "12 or 13", None, "", "99999999999999999999"]
    assert column(spark, values, text.dollar_price("v")) == [1234, 85, 1213, 0, 0, 0]
    assert column(spark, values, text.first_digits("v")) == [1, 85, 12, 0, 0, 0]


def test_guard_is_idempotent(spark):
    values = ["=1", "+34", "-5", "@x", "'=1", "a=1", ""]
    once = text.guard_formula("v")
    assert column(spark, values, once) == column(spark, values, text.guard_formula(once)) == ["'=1", "'+34", "'-5", "'@x", "'=1", "a=1", ""]


def test_literal_alternatives(spark):
    pattern = text.any_of(["a.b", "x\\E*", "foo"], whole=False)
    assert column(spark, ["A.B", "axb", "x\\E*", "FOOD"], F.col("v").rlike(pattern)) == [True, False, True, True]


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="áñüé¿¡ªº€a1 ", max_size=20))
def test_repair_undoes_one_wrong_reading(value):
    from lonja.functions.mojibake import _CHAR_OF

    wrong = "".join(_CHAR_OF[b] for b in value.encode())
    assert repair(wrong) == value


def test_repair_column(spark):
    values = ["ñandú", "plain", None, "Ã", "日本 ™"]
    assert column(spark, values, repair_text(damage("v"))) == ["ñandú", "plain", None, "Ã", "日本 ™"]
    assert column(spark, values, repair_text("v")) == values


def test_urls(spark):
    cell = ["http://a/b.JPG?x=1, https://c/d.png;HTTP://e/f.txt", " https://x/y.webp ", "ftp://a/b.jpg", None, "http://a/b"]
    assert column(spark, cell, urls.image_urls("v")) == [["http://a/b.JPG?x=1", "https://c/d.png"], ["https://x/y.webp"], [], [], []]
    assert column(spark, cell, urls.is_image_url("v")) == [True, True, False, False, False]
    assert column(spark, ["x https://i.example/a/s-l300.jpg y", "a VIDEO", "none", None], urls.listing_image("v")) == ["https://i.example/a/s-l1600.jpg", "", "", ""]
    assert column(spark, ["http://m/i._AC_SX_.x._AC_US_.jpg"], urls.variant_image("v")) == ["http://m/i._AC_SL1500_.x._AC_US_.jpg"]
    assert column(spark, ["http://s/itm/x/123?h", "http://s/123", "http://s/123/x"], urls.item_id("v")) == ["123", "123", ""]
