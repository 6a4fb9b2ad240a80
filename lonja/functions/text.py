"""Text expressions: keys, trimming, tokens, numbers in text. All are ``Column -> Column`` and stay inside codegen."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space as a regex class body: what trimming and the spreadsheet order strip (U+001C to U+001F are not in it).
SPACE = r"\x{09}-\x{0D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
#: Accents that keys fold; ñ is a letter of its own and stays.
FOLD_FROM, FOLD_TO = "áéíóúü", "aeiouu"
#: The decimal grammar of a number cell: no type suffix, no underscore, no word such as nan.
NUMBER = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def as_col(value: Column | str) -> Column:
    return F.col(f"`{value}`") if isinstance(value, str) else value


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.transform(F.array(value), use)[0]


def blank(value: Column | str) -> Column:
    """Null as the empty string."""
    return F.coalesce(as_col(value).cast("string"), F.lit(""))


def trim_space(value: Column | str) -> Column:
    return F.regexp_replace(as_col(value), f"^[{SPACE}]+|[{SPACE}]+\\z", "")


def collapse_space(value: Column | str) -> Column:
    return trim_space(F.regexp_replace(as_col(value), f"[{SPACE}]+", " "))


def fold_accents(value: Column | str) -> Column:
    return F.translate(as_col(value), FOLD_FROM, FOLD_TO)


def clean_key(value: Column | str) -> Column:
    """Lower case, folded, letters a-z, ñ and digits only; null gives the empty key."""
    return F.regexp_replace(fold_accents(F.lower(blank(value))), "[^0-9a-zñ]", "")


def phrase_key(value: Column | str) -> Column:
    """Lower case, folded, every other run of characters one blank, trimmed."""
    return F.trim(F.regexp_replace(fold_accents(F.lower(blank(value))), "[^0-9a-zñ]+", " "))


def char_count(value: Column | str) -> Column:
    """Code points, untrimmed; null has none."""
    return F.char_length(blank(value))


def capitalise(value: Column | str) -> Column:
    """First character upper case, the rest unchanged."""
    value = as_col(value)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.substring(value, 2, 2**31 - 1))


def simple_title(value: Column | str) -> Column:
    """First character upper case, the rest lower case."""
    value = as_col(value)
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(F.substring(value, 2, 2**31 - 1)))


def finite_number(value: Column | str) -> Column:
    """The value of a trimmed cell that is a finite decimal number, else null."""
    text = trim_space(value)
    number = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(number) < float("inf"), number)


def first_digits(value: Column | str) -> Column:
    """The first run of digits as an integer; none or too long gives 0."""
    return F.coalesce(F.regexp_extract(blank(value), "(\\d+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))


def dollar_price(value: Column | str) -> Column:
    """Digits between the first dollar sign and the next point as an integer, 0 if there are none."""
    text = F.coalesce(as_col(value).cast("string"), F.lit("0"))
    text = F.regexp_replace(F.regexp_replace(text, r"^.*?\$", ""), r"\..*\z", "")
    return F.coalesce(F.regexp_replace(text, "[^0-9]", "").try_cast("bigint"), F.lit(0).cast("bigint"))


def null_token(value: Column | str) -> Column:
    """True for the words that stand for nothing: none, nan, nat, null, n/a, with any case and outer space."""
    return F.lower(trim_space(blank(value))).isin("none", "nan", "nat", "null", "n/a")


def blank_null_tokens(value: Column | str) -> Column:
    return F.when(null_token(value), F.lit("")).otherwise(blank(value))


def any_of(words: Iterable[str], whole: bool = False) -> str:
    """A case-insensitive pattern of literal alternatives, longest first."""
    quoted = "|".join("\\Q" + w.replace("\\E", "\\E\\\\E\\Q") + "\\E" for w in sorted(words, key=lambda w: (-len(w.encode()), w)))
    return f"(?iuU)\\b({quoted})\\b" if whole else f"(?iu)(?:{quoted})"


def guard_formula(value: Column | str) -> Column:
    """A leading apostrophe for text that a spreadsheet would run; applying it twice changes nothing."""
    value = as_col(value)
    return F.when(value.rlike("^[=+\\-@]"), F.concat(F.lit("'"), value)).otherwise(value)
