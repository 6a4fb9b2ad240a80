"""Queries of the library's operators over whole tables, and the SQL that each must equal.

Inputs that the test tables lack (titles, codes, delimited lists) are derived from their columns by expressions that both
engines read, kept in the constants below and used in the query and in its SQL alike. ``_ord`` is the table's key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lonja.functions.text import any_of, blank_null_tokens, char_count, dollar_price, finite_number, first_digits, guard_formula, phrase_key
from lonja.functions.urls import image_urls, is_image_url, item_id, listing_image, product_id, variant_image
from lonja.operators import align, cells, dups, lookup, order, rows
from lonja.operators.lookup import Several
from lonja.plans import combine, images, listing, titles
from lonja.session import shared_folder
from lonja.sources.csv import read_csv, write_csv
from lonja.sources.verdicts import append_verdicts, load_verdicts, next_batch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

Build = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[build.__name__] = build
        if sql is not None:
            ORACLE_SQL[build.__name__] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str, key: str | None = None) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumn("_ord", F.col(key)) if key else df


# SQL of the normalisers.


def _fold(x: str) -> str:
    return f"translate(lower(coalesce({x}, '')), 'áéíóúü', 'aeiouu')"


def _clean(x: str) -> str:
    return f"regexp_replace({_fold(x)}, '[^0-9a-zñ]', '', 'g')"


def _phrase(x: str) -> str:
    return f"trim(regexp_replace({_fold(x)}, '[^0-9a-zñ]+', ' ', 'g'))"


# Inputs derived from the tables, in SQL that both engines read.

CODE = "concat(p_brand, case when p_partkey % 3 = 0 then ' ' else '-' end, upper(p_name), case when p_partkey % 50 = 0 then '' else '!' end)"
MIXED = """case p_partkey % 11 when 0 then '' when 1 then '   ' when 2 then cast(p_size as string) when 3 then concat('-', cast(p_size as string), '.50')
 when 4 then upper(p_name) when 5 then p_name when 6 then '1e3' when 7 then 'nan' when 8 then concat(cast(p_size as string), 'd') when 9 then concat(' ', cast(p_partkey as string), ' ')
 else cast(null as string) end"""
TITLE = """case p_partkey % 13
 when 0 then concat(p_brand, ' ', p_name, ' ', p_type, ' assembly ', cast(100000 + p_partkey as string))
 when 1 then concat('Front left ', p_name, ' ', p_type, ' for the long model')
 when 2 then concat(p_name, ' short')
 when 3 then concat('Spare ', p_name, ' 123 124 125 for the heavy duty pump')
 when 4 then concat('Spare ', p_name, ' 1.5 2.5 3.5 4.5 valve cover')
 when 5 then concat('Acme ', p_name, ' ', p_type, ' replacement bracket..')
 when 6 then concat('Spare ', p_name, ' a12b 345c 67d8 9e01 bracket mount')
 when 7 then concat('Part ', p_name, ' AB12345C678D bracket of steel')
 when 8 then concat('Part ', p_name, ' 12345 12345 12345 bracket')
 when 9 then concat('Part ', p_name, ' banned Tool bracket of steel')
 when 10 then concat('Part ', p_name, ' 12-34.567/8901 bracket of steel')
 when 11 then concat('Left right upper ', p_name, ' Pair kit of the strong type')
 else concat('Plain ', p_name, '  ', p_type, '  bracket of strong steel') end"""
LISTING_URL = "concat('https://www.example.com/itm/', p_name, '/', cast(1000 + p_partkey as string), case when p_partkey % 2 = 0 then '?hash=1' else '' end)"
PRODUCT_URL = "concat('https://shop.example.com/dp/B0', cast(p_partkey as string), case when p_partkey % 3 = 0 then '/ref=sr_1' when p_partkey % 3 = 1 then '?th=1' else '' end)"
IMAGE = """case p_partkey % 6 when 0 then '' when 1 then 'see Video here' when 2 then concat('https://img.example.com/a/', cast(p_partkey as string), '/s-l300.jpg')
 when 3 then cast(null as string) when 4 then concat('x "http://img.example.com/b/', cast(p_partkey as string), '/t.png" y') else 'none' end"""
VARIANT = "concat('https://m.example.com/i/', cast(p_partkey as string), case when p_partkey % 2 = 0 then '._AC_SX466_.jpg' else '._AC_US40_._AC_UL60_.jpg' end)"
PRICE = "case p_partkey % 5 when 0 then concat('US $', cast(p_size as string), ',1', cast(p_partkey % 10 as string), '0.99') when 1 then concat('$', cast(p_size as string), '.50') when 2 then cast(p_size * 20 as string) when 3 then '' else cast(null as string) end"
STORE = "concat('Visit the ', p_brand, ' Store. ', p_type)"
OEM = "case p_partkey % 4 when 0 then cast(null as string) when 1 then '' when 2 then '  ' else concat(p_brand, ' ', repeat(p_name, 40)) end"
OPTION = "case when p_partkey % 9 = 0 then 'Red' when p_partkey % 9 = 1 then '' else cast(null as string) end"
PIECES = "concat(p_brand, case when p_partkey % 4 = 0 then '.0' else '' end)"
HYPHENS = "case p_partkey % 4 when 0 then concat(p_name, '-NA') when 1 then concat(cast(p_size as string), '-', cast(p_partkey as string), ' a-b') when 2 then '1-2-3 x-9' else concat(p_name, '-NA-', p_type) end"
FRAME_WORDS = ("brake", "ring", "small ring", "widget", "blue bolt", "gear gizmo", "plate", "hot")
DOC_WORDS = ("the", "of the", "that", "and", "der", "que de", "est", "zzzz", "on", "is with")
BRACKETS = [listing.Bracket(low, low + 99, 5000 + 25 * low) for low in range(1, 1501, 100)]
BRACKET_SQL = "case " + " ".join(f"when price between {b.low} and {b.high} then {b.price}" for b in BRACKETS) + " end"


def _jitter(x: str) -> str:
    return f"(({x} * 2654435761) % 4294967296) % 50 + 1"


def _words(spark: SparkSession, words: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(w, i, f"v{i}") for i, w in enumerate(words)], "word string, _ord long, value string")


def _word_sql(words: tuple[str, ...]) -> str:
    return "(values " + ", ".join(f"('{w}', {i}, 'v{i}')" for i, w in enumerate(words)) + ") as w(word, r, value)"


def _parts(spark: SparkSession, sf_dir: str, **columns: str) -> DataFrame:
    """Part rows with further columns of the given SQL, blanks in names written as two underscores."""
    base = table(spark, sf_dir, "part")
    return base.select("*", F.col("p_partkey").alias("_ord"), *[F.expr(sql).alias(name) for name, sql in columns.items()])


# Keys, duplicates, membership


@query(f"SELECT DISTINCT k AS key FROM (SELECT {_clean(CODE)} AS k FROM part) WHERE k <> ''")
def clean_key_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.distinct_keys(_parts(spark, sf_dir, code=CODE), "code")


@query(f"SELECT k AS key, count(*) AS times FROM (SELECT {_clean(CODE)} AS k FROM part) WHERE k <> '' GROUP BY k HAVING count(*) > 1")
def repeated_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.repeated_keys(_parts(spark, sf_dir, code=CODE), "code")


_MARKED = f"SELECT p_partkey, code, count(*) OVER (PARTITION BY k) AS n, row_number() OVER (PARTITION BY k ORDER BY p_partkey) AS r, k FROM (SELECT *, {_clean('code')} AS k FROM (SELECT *, {CODE} AS code FROM part))"


@query(f"SELECT p_partkey, code FROM ({_MARKED}) WHERE k <> '' AND n > 1")
def dup_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.duplicate_report(_parts(spark, sf_dir, code=CODE), "code").select("p_partkey", "code")


@query(f"SELECT p_partkey, code FROM ({_MARKED}) WHERE k = '' OR r = 1")
def dup_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.without_duplicates(_parts(spark, sf_dir, code=CODE), "code").select("p_partkey", "code")


@query("SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part) WHERE r = 1")
def keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.keep_first(_parts(spark, sf_dir), "p_name").select("p_partkey", "p_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def semi_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return dups.rows_with_key_in(table(spark, sf_dir, "customer"), "c_custkey", orders, "o_custkey").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def anti_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return dups.rows_with_key_in(table(spark, sf_dir, "customer"), "c_custkey", orders, "o_custkey", inside=False).select("c_custkey", "c_name")


_CHEAPEST = "SELECT *, row_number() OVER (PARTITION BY p_name ORDER BY p_retailprice, p_partkey) AS r FROM part"


@query(f"SELECT p_partkey, p_name, p_retailprice FROM ({_CHEAPEST}) WHERE r = 1")
def keep_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.keep_cheapest(_parts(spark, sf_dir), "p_name", "p_retailprice")[0].select("p_partkey", "p_name", "p_retailprice")


@query(f"SELECT p_partkey, 'Duplicado - precio más alto' AS Motivo_Eliminacion FROM ({_CHEAPEST}) WHERE r > 1")
def dearer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dups.keep_cheapest(_parts(spark, sf_dir), "p_name", "p_retailprice")[1].select("p_partkey", "Motivo_Eliminacion")


# Lookups


@query("SELECT coalesce(n_name, '') AS n_name, c_custkey FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")
def vlookup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.exact_table(table(spark, sf_dir, "nation", "n_nationkey"), "n_nationkey", ["n_name"])
    return lookup.exact_lookup(table(spark, sf_dir, "customer"), "c_nationkey", found).select("n_name", "c_custkey")


@query(
    "SELECT coalesce(v, '') AS o_orderpriority, c_custkey FROM customer LEFT JOIN"
    " (SELECT o_custkey, string_agg(coalesce(o_orderpriority, ''), chr(10) ORDER BY o_orderkey) AS v FROM orders GROUP BY 1) ON c_custkey = o_custkey"
)
def vlookup_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.exact_table(table(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", ["o_orderpriority"], every=True)
    return lookup.exact_lookup(table(spark, sf_dir, "customer"), "c_custkey", found).select("o_orderpriority", "c_custkey")


@query("SELECT o_orderstatus, c_custkey FROM customer JOIN (SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1) ON c_custkey = o_custkey")
def vlookup_matched_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.exact_table(table(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", ["o_orderstatus"])
    return lookup.exact_lookup(table(spark, sf_dir, "customer"), "c_custkey", found, matched_only=True).select("o_orderstatus", "c_custkey")


@query("SELECT n_name AS s_name_tabla, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def vlookup_name_clash(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation", "n_nationkey").withColumnRenamed("n_name", "s_name")
    found = lookup.exact_table(nation, "n_nationkey", ["s_name"])
    return lookup.exact_lookup(table(spark, sf_dir, "supplier"), "s_nationkey", found).select("s_name_tabla", "s_suppkey", "s_name")


@query("SELECT count(*) FILTER (c_custkey IN (SELECT o_custkey FROM orders)) AS matched, count(*) AS rows FROM customer")
def vlookup_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.exact_table(table(spark, sf_dir, "orders", "o_orderkey"), "o_custkey", ["o_orderstatus"])
    return lookup.match_counts(table(spark, sf_dir, "customer"), "c_custkey", found)


def _phrase_sql(words: tuple[str, ...], source: str, key: str, text: str, pick: str, label: str) -> str:
    return f"""
    WITH t AS (SELECT {key}, {_phrase(text)} AS t FROM {source}), w AS (SELECT {_phrase('word')} AS k, r, value, word FROM {_word_sql(words)}),
    h AS (SELECT {key}, {pick} AS v FROM t JOIN w ON contains(concat(' ', t, ' '), concat(' ', k, ' ')) GROUP BY {key})
    SELECT t.{key}, coalesce(v, '') AS {label} FROM t LEFT JOIN h ON t.{key} = h.{key}"""


def _phrase_query(spark: SparkSession, sf_dir: str, several: Several, grams: bool = False) -> DataFrame:
    found = lookup.phrase_table(_words(spark, FRAME_WORDS), "word", ["value"])
    return lookup.phrase_lookup(_parts(spark, sf_dir), "p_name", found, several, grams=grams).select("p_partkey", "value")


@query(_phrase_sql(FRAME_WORDS, "part", "p_partkey", "p_name", "arg_min(value, -length(k) * 1000 + r)", "value"))
def vlookup_partial_longest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_query(spark, sf_dir, Several.LONGEST)


@query(_phrase_sql(FRAME_WORDS, "part", "p_partkey", "p_name", "arg_min(value, r)", "value"))
def vlookup_partial_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_query(spark, sf_dir, Several.FIRST)


@query(_phrase_sql(FRAME_WORDS, "part", "p_partkey", "p_name", "string_agg(value, chr(10) ORDER BY r)", "value"))
def vlookup_partial_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _phrase_query(spark, sf_dir, Several.ALL)


@query(_phrase_sql(DOC_WORDS, "documents", "doc_id", "text", "string_agg(value, chr(10) ORDER BY r)", "value"))
def partial_ngram_equiv(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lookup.phrase_table(_words(spark, DOC_WORDS), "word", ["value"])
    return lookup.phrase_lookup(table(spark, sf_dir, "documents", "doc_id"), "text", found, Several.ALL, grams=True).select("doc_id", "value")


@query(_phrase_sql(DOC_WORDS, "documents", "doc_id", "text", "arg_min(word, r)", "Palabra_encontrada"))
def find_words_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lookup.word_table(_words(spark, DOC_WORDS), "word")
    return lookup.find_words(table(spark, sf_dir, "documents", "doc_id"), "text", words).select("doc_id", "Palabra_encontrada")


@query(_phrase_sql(DOC_WORDS, "documents", "doc_id", "text", "string_agg(word, chr(10) ORDER BY r)", "Palabra_encontrada"))
def find_words_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = lookup.word_table(_words(spark, DOC_WORDS), "word")
    return lookup.find_words(table(spark, sf_dir, "documents", "doc_id"), "text", words, Several.ALL).select("doc_id", "Palabra_encontrada")


# Order and ranks

_NUMERIC = "regexp_full_match(t, '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?')"
_SORT = f"""SELECT p_partkey, row_number() OVER (ORDER BY coalesce(t = '', true), num IS NULL {{d}}, num {{d}} NULLS LAST, lower(t) {{d}} NULLS LAST, p_partkey) AS rank
 FROM (SELECT *, CASE WHEN {_NUMERIC} THEN try_cast(t AS DOUBLE) END AS num FROM (SELECT p_partkey, trim({MIXED}) AS t FROM part))"""


@query(_SORT.format(d="ASC"))
def excel_sort_asc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*order.sheet_order("v", True), F.col("_ord").asc()]
    return order.number_rows(_parts(spark, sf_dir, v=MIXED).select("p_partkey", "v", "_ord"), keys).select("p_partkey", "rank")


@query(_SORT.format(d="DESC"))
def excel_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [*order.sheet_order("v", False), F.col("_ord").asc()]
    return order.number_rows(_parts(spark, sf_dir, v=MIXED).select("p_partkey", "v", "_ord"), keys).select("p_partkey", "rank")


@query("SELECT p_partkey, row_number() OVER (ORDER BY length(p_name) DESC, p_partkey) AS rank FROM part")
def sort_by_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [char_count("p_name").desc(), F.col("_ord").asc()]
    return order.number_rows(_parts(spark, sf_dir).select("p_partkey", "p_name", "_ord"), keys).select("p_partkey", "rank")


@query("SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS running FROM lineitem")
def running_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("_ord", F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"))
    return order.running_number(lines, "l_suppkey").select("l_orderkey", "l_linenumber", "l_partkey", "running")


@query(f"SELECT p_partkey FROM part WHERE p_partkey <= (SELECT max(p_partkey) FROM part WHERE coalesce({OPTION}, '') <> '')")
def blank_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order.trim_blank_tail(_parts(spark, sf_dir, option=OPTION), ["option"]).select("p_partkey")


# Rows


@query("SELECT doc_id, length(coalesce(text, ''))::INTEGER AS Caracteres FROM documents")
def char_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.with_length(table(spark, sf_dir, "documents"), "text").select("doc_id", "Caracteres")


@query("SELECT doc_id, CASE WHEN length(coalesce(text, '')) <= 1500 THEN 'Hasta_1500' ELSE 'Mas_de_1500' END AS _route FROM documents")
def length_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.route_by_length(table(spark, sf_dir, "documents"), "text", 1500).select("doc_id", "_route")


@query("SELECT doc_id FROM documents WHERE length(coalesce(text, '')) > 1500")
def length_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.split_by_length(table(spark, sf_dir, "documents"), "text", 1500)[1].select("doc_id")


_CUT = ("small", "BRAND#1", "promo", "eco")
_HIT = "regexp_matches({c}, '(?i)(?:" + "|".join(_CUT) + ")')"
_LIVE = "[x FOR x IN [CASE WHEN " + _HIT.format(c="p_name") + " THEN '' ELSE trim(p_name) END, CASE WHEN " + _HIT.format(c="p_brand") + " THEN '' ELSE trim(p_brand) END, CASE WHEN " + _HIT.format(c="p_type") + " THEN '' ELSE trim(p_type) END] IF x <> '']"
_SHIFT = "SELECT *, " + " + ".join(f"{_HIT.format(c=c)}::INT" for c in ("p_name", "p_brand", "p_type")) + f" AS hits, {_LIVE} AS live FROM part"


@query(
    "SELECT p_partkey, " + ", ".join(f"CASE WHEN hits > 0 THEN coalesce(live[{i}], '') ELSE {c} END AS {c}" for i, c in enumerate(("p_name", "p_brand", "p_type"), 1)) + f" FROM ({_SHIFT}) WHERE NOT (hits > 0 AND len(live) = 0)"
)
def delete_shift_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.delete_words(_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"], _CUT)[0].select("p_partkey", "p_name", "p_brand", "p_type")


@query(
    "SELECT p_partkey, CASE WHEN hits = 3 THEN 'Todas las celdas seleccionadas contienen la palabra a eliminar' ELSE 'Todas las celdas seleccionadas quedaron vacías tras el borrado' END AS Motivo_Borrado"
    f" FROM ({_SHIFT}) WHERE hits > 0 AND len(live) = 0"
)
def delete_shift_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rows.delete_words(_parts(spark, sf_dir), ["p_name", "p_brand", "p_type"], _CUT)[1].select("p_partkey", "Motivo_Borrado")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'error' WHEN value < 5 THEN 'small' WHEN user_id % 2 = 0 THEN 'even' END AS Motivo_Eliminacion FROM events WHERE event_type = 'error' OR value < 5 OR user_id % 2 = 0")
def split_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    reasons = [(F.col("event_type") == "error", "error"), (F.col("value") < 5, "small"), (F.col("user_id") % 2 == 0, "even")]
    return rows.split_by_reason(table(spark, sf_dir, "events"), reasons)[1].select("event_id", "Motivo_Eliminacion")


@query("SELECT 'total' AS what, count(*) AS total_original, count(*) FILTER (value < 5) AS total_borrado, count(*) FILTER (NOT value < 5) AS total_final FROM events")
def change_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return rows.change_report(events, events.where("value < 5")).select(F.lit("total").alias("what"), "total_original", "total_borrado", "total_final")


@query("SELECT o_custkey, unnest(string_split(string_agg(o_orderpriority, '@' ORDER BY o_orderkey), '@')) AS lista FROM orders GROUP BY o_custkey")
def explode_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.expr("listagg(o_orderpriority, '@') WITHIN GROUP (ORDER BY o_orderkey)").alias("lista"))
    return rows.explode_list(lists, "lista")


# Alignment, set operations


@query(
    "SELECT c_custkey::VARCHAR AS id, c_name AS name, c_mktsegment AS segment, '' AS region FROM customer UNION ALL SELECT s_suppkey::VARCHAR, s_name, '', s_nationkey::VARCHAR FROM supplier"
)
def combine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer", "c_custkey").selectExpr("cast(c_custkey as string) as id", "c_name as name", "c_mktsegment as segment", "_ord")
    two = table(spark, sf_dir, "supplier", "s_suppkey").selectExpr("cast(s_suppkey as string) as id", "s_name as name", "cast(s_nationkey as string) as region", "_ord")
    return combine.combine([one, two]).select("id", "name", "segment", "region")


@query(
    "SELECT id, (row_number() OVER (ORDER BY lower(name), f, o) - 1) // 100 + 1 AS _part FROM (SELECT c_custkey::VARCHAR AS id, c_name AS name, 0 AS f, c_custkey AS o FROM customer"
    " UNION ALL SELECT s_suppkey::VARCHAR, s_name, 1, s_suppkey FROM supplier)"
)
def combine_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "customer", "c_custkey").selectExpr("cast(c_custkey as string) as id", "c_name as name", "_ord")
    two = table(spark, sf_dir, "supplier", "s_suppkey").selectExpr("cast(s_suppkey as string) as id", "s_name as name", "_ord")
    options = combine.CombineOptions(sort_column="name", division=combine.Division.FILES, rows_each=100)
    return combine.combine([one, two], options).select("id", F.col("_part").cast("long").alias("_part"))


_TOKEN = "case event_id % 7 when 0 then ' NaN ' when 1 then 'N/A' when 2 then 'none' when 3 then event_type when 4 then ' ' when 5 then cast(null as string) else 'nullable' end"


@query(f"SELECT event_id, CASE WHEN lower(trim(coalesce({_TOKEN}, ''))) IN ('none', 'nan', 'nat', 'null', 'n/a') THEN '' ELSE coalesce({_TOKEN}, '') END AS v FROM events")
def null_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", blank_null_tokens(F.expr(_TOKEN)).alias("v"))


@query("SELECT r_regionkey::BIGINT AS k, r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT n_nationkey::BIGINT, NULL, n_name FROM nation")
def concat_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = table(spark, sf_dir, "region").selectExpr("cast(r_regionkey as bigint) as k", "r_name as a")
    return align.concat_diagonal([one, table(spark, sf_dir, "nation").selectExpr("cast(n_nationkey as bigint) as k", "n_name as b")])


@query(f"SELECT p_partkey, {_phrase(CODE)} AS k FROM part")
def phrase_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", phrase_key(F.expr(CODE)).alias("k"))


# Prices, SKUs, features


@query(f"SELECT o_orderkey, ({BRACKET_SQL})::BIGINT AS list_price FROM (SELECT o_orderkey, (floor(o_totalprice / 250))::BIGINT AS price FROM orders)")
def price_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.floor(F.col("o_totalprice") / 250).cast("long")
    return table(spark, sf_dir, "orders").select("o_orderkey", listing.bracket_price(price, BRACKETS).alias("list_price"))


@query(f"SELECT p_partkey, (({BRACKET_SQL}) - ({_jitter('p_partkey')}))::BIGINT AS Precio2 FROM (SELECT p_partkey, p_size * 20 AS price FROM part)")
def list_price_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", listing.list_price(F.col("p_size") * 20, BRACKETS, F.col("_ord")).cast("long").alias("Precio2"))


@query(
    f"SELECT p_partkey, coalesce(try_cast(regexp_extract(coalesce(p, ''), '([0-9]+)', 1) AS BIGINT), 0) AS digits,"
    f" coalesce(try_cast(regexp_replace(regexp_replace(regexp_replace(coalesce(p, '0'), '^.*?\\$', ''), '\\..*$', ''), '[^0-9]', '', 'g') AS BIGINT), 0) AS dollars FROM (SELECT p_partkey, {PRICE} AS p FROM part)"
)
def price_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, p=PRICE).select("p_partkey", first_digits("p").alias("digits"), dollar_price("p").alias("dollars"))


_SKU = f"concat('u-', {{price}}, '-', regexp_replace({{store}}, '[\\s:_\\-.,*/\\\\]', '', 'g'), '-', {{id}})"
_ITEM = f"regexp_extract({LISTING_URL}, '/([0-9]+)(?:\\?|$)', 1)"
_ASIN = f"regexp_extract(regexp_replace({PRODUCT_URL}, '/ref=.*$', ''), '/dp/([A-Z0-9]+)(?:[/?]|$)', 1)"


@query(f"SELECT p_partkey, {_SKU.format(price='p_size::VARCHAR', store=f'lower({STORE})', id=_ITEM)} AS Sku FROM part")
def sku_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _parts(spark, sf_dir, Precio="p_size", Tienda=STORE).withColumn("web-scraper-start-url", F.expr(LISTING_URL))
    return listing.with_sku(df).select("p_partkey", "Sku")


@query(f"SELECT p_partkey, {_SKU.format(price='p_size::VARCHAR', store=f'''regexp_replace(lower({STORE}), '^visit\\s+the\\s*', '')''', id=_ASIN)} AS Sku FROM part")
def sku_marketplace(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = "regexp_replace(" + PRODUCT_URL + ", '/ref=.*$', '')"
    df = _parts(spark, sf_dir, Precio="p_size", Tienda=STORE).withColumn("web-scraper-start-url", F.expr(url))
    return listing.with_sku(df, product_id("web-scraper-start-url"), visit=True).select("p_partkey", "Sku")


@query(
    "SELECT l_orderkey, l_linenumber, l_partkey, concat('s', l_suppkey::VARCHAR, '-', row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice)::VARCHAR) AS Sku FROM lineitem"
)
def sku_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("Sku", F.concat(F.lit("s"), F.col("l_suppkey").cast("string")))
    return listing.numbered_sku(lines, ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select("l_orderkey", "l_linenumber", "l_partkey", "Sku")


_MAP_SQL = "map {" + ", ".join(f"'{k}': '{v}'" for k, v in listing.FEATURES.items()) + "}"


def _features_sql(t: str) -> str:
    found = f"list_filter(list_transform(regexp_extract_all(lower({t}), '\\b\\w+\\b'), lambda w: {_MAP_SQL}[w]), lambda v: v IS NOT NULL)"
    first = f"list_filter(f, lambda v, i: list_position(f, v) = i)"
    kept = "u"
    for a, b in listing.OPPOSITES:
        kept = f"(CASE WHEN list_contains(u, '{a}') AND list_contains(u, '{b}') THEN list_filter({kept}, lambda v: v NOT IN ('{a}', '{b}')) ELSE {kept} END)"
    shown = f"list_transform({kept}, lambda v: upper(v[1]) || v[2:])"
    return f"SELECT p_partkey, CASE WHEN len(s) = 0 THEN '' ELSE array_to_string(s, ' ') || ' ' END AS Caracteristicas FROM (SELECT p_partkey, {shown} AS s FROM (SELECT p_partkey, {first} AS u FROM (SELECT p_partkey, {found} AS f FROM part)))"


@query(_features_sql(TITLE))
def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t=TITLE).select("p_partkey", listing.features("t").alias("Caracteristicas"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(t, '\\bkit\\b') THEN 'Kit' WHEN regexp_matches(t, '\\bpair\\b') THEN 'Par' WHEN regexp_matches(t, '\\b(set|pcs)\\b') THEN 'Set' ELSE '' END AS Cantidades FROM (SELECT p_partkey, lower({TITLE}) AS t FROM part)")
def quantity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, t=TITLE).select("p_partkey", listing.quantity("t").alias("Cantidades"))


@query(f"SELECT p_partkey, coalesce(o, 'US123400') AS OEM, CASE WHEN trim(coalesce(o, 'US123400')) = '' THEN 'US123400' ELSE left(coalesce(o, 'US123400'), 250) END AS OEM3 FROM (SELECT p_partkey, {OEM} AS o FROM part)")
def oem_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.with_oem3(_parts(spark, sf_dir, OEM=OEM)).select("p_partkey", "OEM", "OEM3")


@query(f"SELECT p_partkey, trim(regexp_replace(concat(regexp_replace({PIECES}, '\\.0$', ''), ' ', p_name, ' ', coalesce({OPTION}, ''), ' ', p_type), '\\s+', ' ', 'g')) AS Combinada FROM part")
def combinada(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, a=PIECES, o=OPTION).select("p_partkey", listing.combined(["a", "p_name", "o", "p_type"]).alias("Combinada"))


@query(f"SELECT p_partkey, replace(replace(regexp_replace(regexp_replace(h, '-NA$', ''), '([0-9])-([0-9])', '\\1@@HYPHEN@@\\2', 'g'), '-', ' '), '@@HYPHEN@@', '-') AS h FROM (SELECT p_partkey, {HYPHENS} AS h FROM part)")
def hyphen_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, h=HYPHENS).select("p_partkey", listing.clean_hyphens("h").alias("h"))


_PRODUCTS = f"SELECT p_partkey, {PRICE} AS Precio, {OPTION} AS Opcion, {IMAGE} AS img, {LISTING_URL} AS u, {STORE} AS t, {TITLE} AS Titulo FROM part"
_CLEAN_IMG = "CASE WHEN regexp_matches(lower(coalesce(img, '')), 'video') THEN '' ELSE regexp_replace(regexp_extract(coalesce(img, ''), '(https?[^\\s\"]+)', 1), '/[^/]*$', '/s-l1600.jpg') END"


def _scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _parts(spark, sf_dir, Precio=PRICE, Opcion=OPTION, Tienda=STORE, Titulo=TITLE)
    return df.withColumns({"Imagen 1": F.expr(IMAGE), "web-scraper-start-url": F.expr(LISTING_URL)})


@query(f"SELECT p_partkey, i AS imagen FROM (SELECT *, {_CLEAN_IMG} AS i FROM ({_PRODUCTS})) WHERE coalesce(Opcion, '') = '' AND i <> ''")
def unique_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.unique_listings(_scrape(spark, sf_dir), BRACKETS)["Hoja1"].select("p_partkey", F.col("`Imagen 1`").alias("imagen"))


@query(f"SELECT p_partkey, CASE WHEN coalesce(Opcion, '') <> '' THEN 'Tiene contenido en Opcion' ELSE 'Sin imágenes' END AS Motivo_Eliminacion FROM (SELECT *, {_CLEAN_IMG} AS i FROM ({_PRODUCTS})) WHERE coalesce(Opcion, '') <> '' OR i = ''")
def unique_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.unique_listings(_scrape(spark, sf_dir), BRACKETS)["Eliminadas"].select("p_partkey", "Motivo_Eliminacion")


@query(
    f"SELECT p_partkey, CASE WHEN coalesce(Opcion, '') <> '' THEN 'Tiene contenido en Opcion' WHEN coalesce(img, '') = '' THEN 'Sin imágenes' ELSE 'Precio es 0' END AS Motivo_Eliminacion"
    f" FROM ({_PRODUCTS}) WHERE coalesce(Opcion, '') <> '' OR coalesce(img, '') = '' OR coalesce(try_cast(regexp_extract(coalesce(Precio, ''), '([0-9]+)', 1) AS BIGINT), 0) = 0"
)
def marketplace_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _parts(spark, sf_dir, Precio=PRICE, Opcion=OPTION, Tienda=STORE).withColumns({"Imagen 1-src": F.expr(IMAGE), "product-link-href": F.expr(PRODUCT_URL)})
    return listing.marketplace_listings(df, BRACKETS)["Eliminadas"].select("p_partkey", "Motivo_Eliminacion")


@query(f"SELECT p_partkey, regexp_replace({VARIANT}, '[.]_AC_.*?_[.]', '._AC_SL1500_.') AS img FROM part")
def variant_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", variant_image(F.expr(VARIANT)).alias("img"))


# Product by compatibility join: parts are products, order lines of a part are its compatibility rows.

_KEPT = f"SELECT p_partkey, cast(p_partkey as string) AS u FROM part WHERE coalesce({OPTION}, '') = '' AND NOT (coalesce({IMAGE}, '') = '' OR regexp_matches(lower({IMAGE}), 'video'))"


def _products(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = _parts(spark, sf_dir, Precio="concat('$', cast(p_size as string), '.10')", Opcion=OPTION, Tienda=STORE)
    named = df.withColumns({"Imagen 1": F.expr(IMAGE), "web-scraper-start-url": F.expr("cast(p_partkey as string)")})
    return named.select("p_partkey", "Precio", "Opcion", "Tienda", "`Imagen 1`", "web-scraper-start-url", "_ord")


def _vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    named = lines.selectExpr("cast(l_partkey as string) as `web-scraper-start-url`", "concat('Make', l_returnflag) as Marca", "concat('Model ', cast(l_suppkey % 7 as string), '.0') as Modelo", "l_linestatus as Linea")
    return named.withColumn("_ord", F.xxhash64("web-scraper-start-url", "Marca", "Modelo", "Linea"))


_VEHICLES = "SELECT DISTINCT l_partkey::VARCHAR AS u, concat('Make', l_returnflag) AS a, concat('Model ', (l_suppkey % 7)::VARCHAR) AS m, l_linestatus AS l FROM lineitem"


@query(f"SELECT DISTINCT concat(a, ' ', m, ' ', l) AS Combinada FROM ({_KEPT}) JOIN ({_VEHICLES}) USING (u)")
def compat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.compatibility(_products(spark, sf_dir), _vehicles(spark, sf_dir), BRACKETS, listing.Mode.REPEATED)["Procesadas"].select("Combinada")


@query(
    f"SELECT c AS Combinada, min(p2)::BIGINT AS Precio2 FROM (SELECT concat(a, ' ', m, ' ', l) AS c, ({BRACKET_SQL}) - ({_jitter('k.p_partkey')}) AS p2"
    f" FROM ({_KEPT}) k JOIN (SELECT p_partkey, p_size AS price FROM part) p USING (p_partkey) JOIN ({_VEHICLES}) USING (u)) GROUP BY c"
)
def compat_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = listing.compatibility(_products(spark, sf_dir), _vehicles(spark, sf_dir), BRACKETS, listing.Mode.REPEATED)
    return routes["Procesadas"].select("Combinada", F.col("Precio2").cast("long").alias("Precio2"))


@query(f"SELECT p_partkey FROM ({_KEPT}) WHERE u NOT IN (SELECT (CASE WHEN l_partkey % 4 = 0 THEN -l_partkey ELSE l_partkey END)::VARCHAR FROM lineitem)")
def compat_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth part is written with another key on the order lines, so it has no match."""
    lines = table(spark, sf_dir, "lineitem").selectExpr("cast(if(l_partkey % 4 = 0, -l_partkey, l_partkey) as string) as `web-scraper-start-url`", "l_returnflag as Marca", "l_orderkey * 8 + l_linenumber as _ord")
    return listing.compatibility(_products(spark, sf_dir), lines, BRACKETS, listing.Mode.REPEATED)["No_Procesadas"].select("p_partkey")


_LISTS = "SELECT l_partkey::VARCHAR AS u, string_agg(concat(l_returnflag, l_linestatus, '-', (l_suppkey % 10)::VARCHAR, '-', l_linenumber::VARCHAR), '@' ORDER BY l_orderkey, l_linenumber, l_extendedprice) AS c FROM lineitem GROUP BY 1"


@query(f"SELECT DISTINCT regexp_replace(x, '^([A-Z]+)-', '\\1 ') AS Combinada FROM (SELECT unnest(string_split(c, '@')) AS x FROM ({_KEPT}) JOIN ({_LISTS}) USING (u))")
def compat_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    lists = lines.groupBy(F.col("l_partkey").cast("string").alias("web-scraper-start-url")).agg(
        F.expr("array_join(transform(array_sort(collect_list(struct(l_orderkey, l_linenumber, l_extendedprice, concat(l_returnflag, l_linestatus, '-', cast(l_suppkey % 10 as string), '-', cast(l_linenumber as string)) as c))), x -> x.c), '@')").alias("Coincidencia")
    )
    sheets = lists.withColumn("_ord", F.col("web-scraper-start-url").cast("long"))
    return listing.compatibility(_products(spark, sf_dir), sheets, BRACKETS, listing.Mode.COMPRESSED)["Procesadas"].select("Combinada")


# Titles

WORDS = titles.Vocabulary(brands=("acme", "plain"), critical=("spare",), forbidden=("banned tool", "banned"))
_TOKENS = "(" + ", ".join(f"'{w}'" for w in WORDS.tokens()) + ")"
_CLEANED = f"""SELECT p_partkey, p_retailprice, t, regexp_extract(t, '(?i)\\b(banned tool|banned)\\b', 1) AS bad,
 trim(regexp_replace(array_to_string(list_filter(string_split(trim(regexp_replace(regexp_replace(t, '[\\n\\r.]+$', ''), '\\s+', ' ', 'g')), ' '), lambda w: lower(w) NOT IN {_TOKENS}), ' '), '\\s+', ' ', 'g')) AS c
 FROM (SELECT *, {TITLE} AS t FROM part)"""
_STRIPPED = "list_transform(string_split(c, ' '), lambda w: regexp_replace(w, '[/.*,-]', '', 'g'))"
_SEQ = "|".join(rf"\b{d}\d{{2,3}}(?:\s+{d}\d{{2,3}}){{2,}}\b" for d in range(1, 10))
_SEGMENT = r"(?:\b[a-zA-Z0-9]{3,4}[\s/]){3,}\b[a-zA-Z0-9]{3,4}\b"
_REASON = f"""CASE WHEN bad <> '' THEN concat('{titles.FORBIDDEN}', bad, ')')
 WHEN regexp_matches(c, '\\d{{6}}') THEN '{titles.SIX_DIGITS}'
 WHEN length(c) < 30 OR length(c) > 60 THEN concat('{titles.LENGTH}', length(c)::VARCHAR, ' caracteres')
 WHEN length(regexp_replace(c, '[^0-9]', '', 'g')) >= 14 THEN '{titles.RULE_4}'
 WHEN len(list_filter({_STRIPPED}, lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) > 9)) > 0 THEN '{titles.RULE_1}'
 WHEN len(list_filter({_STRIPPED}, lambda w: length(regexp_replace(w, '[^0-9]', '', 'g')) >= 7 AND length(regexp_replace(w, '[^A-Za-z]', '', 'g')) >= 3)) > 0 THEN '{titles.RULE_2}'
 WHEN regexp_matches(c, '{_SEQ}') THEN '{titles.RULE_3}'
 WHEN regexp_matches(c, '(?:\\d+\\.\\d+[\\s/]){{3,}}\\d+\\.\\d+') THEN '{titles.RULE_5}'
 WHEN len(regexp_extract_all(regexp_extract(c, '{_SEGMENT}.*'), '\\b\\w*\\d\\w*\\d\\w*\\d\\w*\\b')) >= 3 THEN '{titles.RULE_6}' END"""
_JUDGED = f"SELECT p_partkey, p_retailprice, CASE WHEN bad <> '' THEN t ELSE c END AS Traducido, {_REASON} AS Motivo_Eliminacion FROM ({_CLEANED})"


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, Traducido=TITLE, Precio2="cast(p_retailprice as string)", _sheet="'Hoja1'").select("p_partkey", "Traducido", "Precio2", "_sheet", "_ord")


@query(f"SELECT p_partkey, Traducido, Motivo_Eliminacion FROM ({_JUDGED})")
def title_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.judge_titles(_titles(spark, sf_dir), "Traducido", WORDS).select("p_partkey", "Traducido", "Motivo_Eliminacion")


@query(f"SELECT Motivo_Eliminacion, count(*) AS n FROM (SELECT coalesce(Motivo_Eliminacion, CASE WHEN row_number() OVER (PARTITION BY Motivo_Eliminacion IS NULL, Traducido ORDER BY p_retailprice, p_partkey) > 1 THEN 'Duplicado - precio más alto' END) AS Motivo_Eliminacion FROM ({_JUDGED})) WHERE Motivo_Eliminacion IS NOT NULL GROUP BY 1")
def title_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.validate(_titles(spark, sf_dir), WORDS)["Eliminadas"].groupBy("Motivo_Eliminacion").agg(F.count("*").alias("n"))


@query(f"SELECT p_partkey, Traducido FROM (SELECT *, row_number() OVER (PARTITION BY Traducido ORDER BY p_retailprice, p_partkey) AS r FROM ({_JUDGED}) WHERE Motivo_Eliminacion IS NULL) WHERE r = 1")
def title_cheapest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.validate(_titles(spark, sf_dir), WORDS)["validas"].select("p_partkey", "Traducido")


@query("SELECT doc_id, regexp_matches(text, '(?i)(?:" + "|".join(DOC_WORDS) + ")') AS hit FROM documents")
def word_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").rlike(any_of(DOC_WORDS)).alias("hit"))


# URLs, images, verdicts

CELL = """case page_id % 5 when 0 then concat(url, '.JPG?w=1, ', url, '/b.png') when 1 then concat(' HTTPS://x.example.com/', cast(page_id as string), '.webp') when 2 then url
 when 3 then '' else concat('http://y.example.com/a.gif;http://y.example.com/b.txt') end"""
_IS_IMAGE = "regexp_matches(lower(trim({u})), '^https?://') AND regexp_matches(lower(split_part(trim({u}), '?', 1)), '[.](jpg|jpeg|png|webp|bmp|tiff|gif)$')"


@query(f"SELECT page_id, unnest(list_filter(regexp_extract_all({CELL}, '(?i:https?)://[^\\s,;]+'), lambda u: {_IS_IMAGE.format(u='u')})) AS url FROM pages")
def url_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.explode(image_urls(F.expr(CELL))).alias("url"))


@query(f"SELECT page_id, {_IS_IMAGE.format(u=f'({CELL})')} AS is_image FROM pages")
def url_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", is_image_url(F.expr(CELL)).alias("is_image"))


_SLOTS = "[CASE WHEN page_id % 2 = 0 THEN 'nan' ELSE url END, CASE WHEN page_id % 3 = 0 THEN '' ELSE concat(url, '#2') END, CASE WHEN page_id % 5 = 0 THEN NULL ELSE concat(url, '#3') END]"


@query(f"SELECT page_id, coalesce(v[1], '') AS a, coalesce(v[2], '') AS b, coalesce(v[3], '') AS c FROM (SELECT page_id, list_filter({_SLOTS}, lambda x: coalesce(lower(trim(x)), '') NOT IN ('', 'nan')) AS v FROM pages)")
def url_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages").selectExpr("page_id", "if(page_id % 2 = 0, 'nan', url) as a", "if(page_id % 3 = 0, '', concat(url, '#2')) as b", "if(page_id % 5 = 0, null, concat(url, '#3')) as c")
    return rows.compact_left(df, ["a", "b", "c"])


@query("SELECT 'imagen' AS col")
def url_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "pages", "page_id").withColumn("imagen", F.concat("url", F.lit(".jpg"))).withColumn("imagen", F.regexp_replace("imagen", r"\?.*", ".jpg"))
    return spark.createDataFrame([(c,) for c in cells.url_columns(df)], "col string")


def _judged_cells(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Documents as rows with two image cells, labels as verdicts: quality on the first, toxicity on the second."""
    docs = table(spark, sf_dir, "documents", "doc_id").selectExpr("doc_id", "concat('http://a/', doc_id, '.jpg') as a", "concat('http://b/', doc_id, '.jpg') as b", "_ord")
    labels = table(spark, sf_dir, "labels")
    pairs = "explode(array(struct('a' as col, quality = 1 as approved, if(quality = 1, '', 'low') as reason), struct('b' as col, toxic = 0 as approved, if(toxic = 0, '', 'toxic') as reason))) as v"
    return docs, labels.selectExpr("doc_id as idx", pairs).select("idx", "v.col", "v.approved", "v.reason")


_VERDICTS = "SELECT d.doc_id, coalesce(quality, 1) = 1 AS qa, coalesce(toxic, 0) = 0 AS qb FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"


@query(
    f"SELECT doc_id, CASE WHEN qa THEN concat('http://a/', doc_id::VARCHAR, '.jpg') ELSE '' END AS a, CASE WHEN qb THEN concat('http://b/', doc_id::VARCHAR, '.jpg') ELSE '' END AS b,"
    f" qa OR qb AS _imagen_aprobada, NOT qa OR NOT qb AS _tiene_rechazada, array_to_string(list_filter([CASE WHEN NOT qa THEN '[a] low' END, CASE WHEN NOT qb THEN '[b] toxic' END], lambda x: x IS NOT NULL), ' | ') AS _imagen_motivo FROM ({_VERDICTS})"
)
def verdict_materialise(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, verdicts = _judged_cells(spark, sf_dir)
    return cells.apply_verdicts(docs, ["a", "b"], verdicts).select("doc_id", "a", "b", "_imagen_aprobada", "_tiene_rechazada", "_imagen_motivo")


@query(
    f"SELECT doc_id, CASE WHEN NOT qa THEN concat('http://a/', doc_id::VARCHAR, '.jpg') ELSE concat('http://b/', doc_id::VARCHAR, '.jpg') END AS a, CASE WHEN NOT qa AND NOT qb THEN concat('http://b/', doc_id::VARCHAR, '.jpg') ELSE '' END AS b,"
    f" CASE WHEN NOT qa AND NOT qb THEN '[Imagen 1] low | [Imagen 2] toxic' WHEN NOT qa THEN '[Imagen 1] low' ELSE '[Imagen 1] toxic' END AS Motivo_Rechazo FROM ({_VERDICTS}) WHERE NOT qa OR NOT qb"
)
def verdict_reject_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, verdicts = _judged_cells(spark, sf_dir)
    result = cells.apply_verdicts(docs, ["a", "b"], verdicts)
    return cells.rejected_rows(result, docs, ["a", "b"], rejected_only=True).select("doc_id", "a", "b", "Motivo_Rechazo")


@query("SELECT d.doc_id AS idx, c.col FROM documents d, (VALUES ('a'), ('b')) c(col) WHERE d.doc_id NOT IN (SELECT doc_id FROM labels)")
def verdict_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, verdicts = _judged_cells(spark, sf_dir)
    return cells.pending(docs, ["a", "b"], verdicts).select("idx", "col")


@query("SELECT 2 * count(*) AS analizadas, (count(*) FILTER (quality <> 1) + count(*) FILTER (toxic <> 0)) AS rechazadas FROM labels")
def verdict_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cells.verdict_counts(_judged_cells(spark, sf_dir)[1])


_OCR = images.TextRules(commercial=("est", "und", "the", "der die", "que la"), placeholders=("the of", "der und die", "la que"))
_FRAGMENTS = "transform(split(text, '[.]'), t -> struct(array(array(500.0f, 500.0f), array(510.0f, 500.0f), array(510.0f, 510.0f), array(500.0f, 510.0f)) as bbox, t as text, 0.9f as confidence, cast(0 as double) as saturation))"
_OCR_TEXT = "list_filter(list_transform(string_split(text, '.'), lambda t: trim(regexp_replace(t, '^\\s+|\\s+$', '', 'g'))), lambda t: length(t) >= 3)"


@query(
    f"""SELECT conv_id, turn, CASE WHEN list_has_all(w, ['the', 'of']) THEN 'D6·Imagen placeholder: contiene ''the of''' WHEN list_has_all(w, ['der', 'und', 'die']) THEN 'D6·Imagen placeholder: contiene ''der und die'''
 WHEN list_has_all(w, ['la', 'que']) THEN 'D6·Imagen placeholder: contiene ''la que''' END AS reason
 FROM (SELECT conv_id, turn, string_split_regex(lower(array_to_string({_OCR_TEXT}, ' ')), '\\s+') AS w FROM conversations)"""
)
def ocr_placeholder(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = images.valid_fragments(F.expr(_FRAGMENTS), _OCR)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", images.placeholder_reason(valid, _OCR).alias("reason"))


@query(
    f"""SELECT conv_id, turn, CASE WHEN contains(j, 'der die') THEN 'D4·Texto comercial (frase): ''der die''' WHEN contains(j, 'que la') THEN 'D4·Texto comercial (frase): ''que la''' END AS reason
 FROM (SELECT conv_id, turn, lower(array_to_string({_OCR_TEXT}, ' ')) AS j FROM conversations)"""
)
def ocr_phrase(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = images.valid_fragments(F.expr(_FRAGMENTS), _OCR)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", images.phrase_reason(valid, _OCR).alias("reason"))


@query(f"SELECT conv_id, turn, len(list_filter({_OCR_TEXT}, lambda t: len(list_intersect(string_split_regex(lower(t), '\\s+'), ['est', 'und', 'the'])) > 0))::INTEGER AS n FROM conversations")
def ocr_commercial(spark: SparkSession, sf_dir: str) -> DataFrame:
    valid = images.valid_fragments(F.expr(_FRAGMENTS), _OCR)
    found = images.fragment_reasons(valid, F.lit(1000.0), F.lit(1000.0), _OCR)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).alias("n"))


# Repair, guard, synthetic images


@query("SELECT doc_id, text FROM documents")
def mojibake_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts read as Windows-1252 by mistake come back as they were."""
    from lonja.functions.mojibake import damage, repair_text

    return table(spark, sf_dir, "documents").select("doc_id", damage("text").alias("text")).select("doc_id", repair_text("text").alias("text"))


@query(f"SELECT p_partkey, CASE WHEN regexp_matches(v, '^[=+\\-@]') THEN concat('''', v) ELSE v END AS v FROM (SELECT p_partkey, concat(CASE p_partkey % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END, p_name) AS v FROM part)")
def formula_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = "concat(case p_partkey % 4 when 0 then '=' when 1 then '-' when 2 then '@' else '' end, p_name)"
    return _parts(spark, sf_dir).select("p_partkey", guard_formula(guard_formula(F.expr(cell))).alias("v"))


@query(f"SELECT p_partkey, CASE WHEN {_NUMERIC} THEN try_cast(t AS DOUBLE) END AS number FROM (SELECT p_partkey, trim({MIXED}) AS t FROM part)")
def numbers_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", finite_number(F.expr(MIXED)).alias("number"))


@query(f"SELECT p_partkey, {_ITEM} AS item, {_ASIN} AS product FROM part")
def url_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.functions.urls import cut_reference

    return _parts(spark, sf_dir).select("p_partkey", item_id(F.expr(LISTING_URL)).alias("item"), product_id(cut_reference(F.expr(PRODUCT_URL))).alias("product"))


@query(f"SELECT p_partkey, {_CLEAN_IMG} AS img FROM ({_PRODUCTS})")
def listing_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir).select("p_partkey", listing_image(F.expr(IMAGE)).alias("img"))


@query("SELECT p_partkey, upper(left(p_type, 1)) || lower(substr(p_type, 2)) AS a, upper(left(p_name, 1)) || substr(p_name, 2) AS b FROM part")
def title_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lonja.functions.text import capitalise, simple_title

    return _parts(spark, sf_dir).select("p_partkey", simple_title("p_type").alias("a"), capitalise("p_name").alias("b"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'D1' WHEN p_partkey % 4 = 1 THEN 'D2' END AS rule FROM part")
def image_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic 60 x 60 images, one a part: saturated top band, dark corners, neutral, light."""
    data = F.expr(f"case p_partkey % 4 when 0 then {_solid('DC1414', 900)} when 1 then {_solid('000000', 3600)} else {_solid('000000', 0)} end")
    reason = images.pixel_reason(F.lit(60), F.lit(60), data)
    # A small file of keys is one task, and the keys stand for many bytes of pixels: they are dealt out first.
    keys = _parts(spark, sf_dir).select("p_partkey").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    return keys.select("p_partkey", F.when(reason.isNotNull(), F.substring(reason, 1, 2)).alias("rule"))


def _solid(colour: str, pixels: int) -> str:
    """Bytes of a 60 x 60 image whose first pixels have a colour and the rest are light grey."""
    return f"unhex(concat(repeat('{colour}', {pixels}), repeat('C8C8C8', {3600 - pixels})))"



# Text rules with fragments at computed places

_AT = "(p_partkey % 40) * 25.0"


@query(f"SELECT p_partkey, (pow(least(x, 1000 - x), 2) * 2 <= 220 * 220 AND p_size > 25) AS logo FROM (SELECT p_partkey, p_size, {_AT} AS x FROM part)")
def ocr_corner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word on the diagonal of an image of side 1000, as coloured as the part is large."""
    fragment = F.expr(f"array(named_struct('bbox', array_repeat(array({_AT}, {_AT}), 4), 'text', 'logo', 'confidence', 0.9D, 'saturation', double(p_size)))")
    found = images.fragment_reasons(fragment.cast("array<struct<bbox: array<array<double>>, text: string, confidence: double, saturation: double>>"), F.lit(1000.0), F.lit(1000.0))
    return _parts(spark, sf_dir).select("p_partkey", (F.size(found) > 0).alias("logo"))


@query("SELECT p_partkey, least(5, p_partkey % 9)::INTEGER AS reasons FROM part")
def ocr_reason_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = "named_struct('bbox', array_repeat(array(500D, 500D), 4), 'text', 'sale now', 'confidence', 0.9D, 'saturation', 0D)"
    reason = images.text_reason(F.expr(f"array_repeat({one}, int(p_partkey % 9))"), F.lit(1000.0), F.lit(1000.0))
    return _parts(spark, sf_dir).select("p_partkey", F.when(reason.isNull(), 0).otherwise(F.size(F.split(reason, r" \| "))).alias("reasons"))


# Columns and rows by name and place


@query("SELECT NULL::VARCHAR AS extra, p_size::VARCHAR AS p_size, p_partkey::VARCHAR AS p_partkey, p_name FROM part")
def align_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return align.align(df, ["extra", "p_size", "p_partkey"], extras=True)


@query(f"SELECT p_partkey, coalesce({OPTION}, '') AS a, coalesce({MIXED}, '') AS b FROM part")
def fill_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.fill_text(_parts(spark, sf_dir, a=OPTION, b=MIXED), ["a", "b", "no such column"]).select("p_partkey", "a", "b")


@query("SELECT o_orderkey, c_custkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def take_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers by their place, as often as orders name them."""
    places = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("_ord"))
    return align.take_rows(table(spark, sf_dir, "customer", "c_custkey").select("_ord", "c_custkey", "c_name"), places).select("o_orderkey", "c_custkey", "c_name")


@query("SELECT n_nationkey, coalesce(sum(n_regionkey) OVER (ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM nation")
def prefix_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    summed = order.prefix_sum(table(spark, sf_dir, "nation"), "n_regionkey", "n_nationkey")
    return summed.select("n_nationkey", F.col("before").cast("long").alias("before"))


_SHEET = "case p_partkey % 5 when 0 then concat('Hoja', cast(p_size as string)) when 1 then concat(' HOJA', cast(p_size as string), ' ') when 2 then 'hoja' when 3 then concat('hoja', cast(p_size as string), 'b') else 'Resumen' end"


@query(f"SELECT p_partkey, regexp_matches(s, '^hoja[0-9]+$') AND s <> 'hoja1' AS compatibility FROM (SELECT p_partkey, lower(trim({_SHEET})) AS s FROM part)")
def compat_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parts(spark, sf_dir, s=_SHEET).select("p_partkey", listing.is_compatibility_sheet("s").alias("compatibility"))


@query("SELECT i AS position, name FROM (SELECT generate_subscripts(n, 1) AS i, unnest(n) AS name FROM (SELECT ['a', 'Columna_2', 'b', 'a_1', 'Columna_5', 'a_2'] AS n))")
def header_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = align.header_names(["a", " ", " b ", "a", None, "a"])
    return spark.createDataFrame(list(enumerate(names, 1)), "position int, name string").withColumn("position", F.col("position").cast("long"))


# Files: written, then read back


@query("SELECT p_partkey::VARCHAR AS p_partkey, p_name, concat('say \"', p_type, '\",' || chr(10) || ' ', p_brand) AS note FROM part")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with quotes, commas and line breaks come back as they were."""
    path = shared_folder(spark, "csv") + "/parts"
    df = table(spark, sf_dir, "part", "p_partkey").selectExpr("p_partkey", "p_name", r"concat('say \"', p_type, '\",\n ', p_brand) as note", "_ord")
    write_csv(df, path)
    return read_csv(spark, [path]).select("p_partkey", "p_name", "note")


@query("SELECT p_partkey AS idx, 'Imagen 1' AS col, p_partkey % 3 > 0 AND p_partkey % 2 = 1 AS approved, CASE WHEN p_partkey % 3 = 0 THEN 'D2·á \"x\"' WHEN p_partkey % 2 = 0 THEN 'D1' ELSE '' END AS reason FROM part")
def verdict_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches; the later one judges every third cell again."""
    path = shared_folder(spark, "verdicts") + "/store"
    cells_of = _parts(spark, sf_dir).withColumns({"idx": F.col("p_partkey"), "col": F.lit("Imagen 1")})
    append_verdicts(cells_of.selectExpr("idx", "col", "p_partkey % 2 = 1 as approved", "if(p_partkey % 2 = 1, '', 'D1') as reason"), path, next_batch(spark, path))
    append_verdicts(cells_of.where("p_partkey % 3 = 0").selectExpr("idx", "col", "false as approved", "'D2·á \"x\"' as reason"), path, next_batch(spark, path))
    return load_verdicts(spark, path)
