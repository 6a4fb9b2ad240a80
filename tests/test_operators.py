import random

import pytest
from pyspark.sql import functions as F

from lonja.operators import align, cells, dups, lookup, order, rows
from lonja.operators.lookup import Several
from lonja.plans import combine, listing, titles


def frame(spark, schema, values, partitions=None):
    df = spark.createDataFrame(values, schema)
    return df.repartition(partitions) if partitions else df


def test_headers():
    assert align.header_names(["a", "a", None, " a ", "a_1", ""]) == ["a", "a_1", "Columna_3", "a_2", "a_1_1", "Columna_6"]
    names = align.header_names(["x", "x", ""])
    assert align.header_names(names) == names


def test_reserved_names():
    assert align.reserved_in(["a", "_rank", "_font_color_x"], "etl") == ["_rank", "_font_color_x"]
    with pytest.raises(ValueError):
        align.refuse_reserved(["Sku"], "builder")


def test_align_and_rename(spark):
    warned = []
    df = frame(spark, "a int, z string", [(1, "x")])
    assert align.align(df, ["b", "a"], warn=warned.append).collect() == [(None, "1")] and warned == [["z"]]
    assert align.align(df, ["b", "a"], extras=True, fill="").columns == ["b", "a", "z"]
    assert align.rename_brought(["c", "c_tabla"], ["c", "d"]) == {"c": "c_tabla2", "d": "d"}


@pytest.mark.parametrize("partitions", [1, 7, 30])
def test_duplicates_do_not_depend_on_partitions(spark, partitions):
    rng = random.Random(1)
    data = [(i, rng.choice(["Ab", "a-b", "", None, "ñ", "N", f"u{i}"])) for i in range(200)]
    df = frame(spark, "_ord long, k string", data, partitions)
    key = lambda v: "".join(c for c in (v or "").lower() if c.isalnum())
    count = {}
    for _, v in data:
        count[key(v)] = count.get(key(v), 0) + 1
    seen, clean, report = set(), [], []
    for i, v in data:
        k = key(v)
        if k and count[k] > 1:
            report.append(i)
        if not k or k not in seen:
            clean.append(i)
        seen.add(k)
    assert sorted(r._ord for r in dups.duplicate_report(df, "k").collect()) == report
    assert sorted(r._ord for r in dups.without_duplicates(df, "k").collect()) == clean


def test_cheapest_and_bad_prices(spark):
    data = [(0, "t", "10"), (1, "t", "9"), (2, "t", "nan"), (3, "u", "bad"), (4, "u", None), (5, "v", "inf"), (6, "v", "3"), (7, "w", "2"), (8, "w", " 2.0 ")]
    kept, lost = dups.keep_cheapest(frame(spark, "_ord long, t string, p string", data), "t", "p")
    assert sorted(r._ord for r in kept.collect()) == [1, 3, 6, 7] and sorted(r._ord for r in lost.collect()) == [0, 2, 4, 5, 8]


def test_grams_equal_theta(spark):
    rng = random.Random(2)
    words = ["uno", "dos", "tres", "ñu", "x1"]
    texts = [(i, " ".join(rng.choices(words, k=rng.randint(0, 9))) if i % 9 else None) for i in range(150)]
    keys = [(i, " ".join(rng.choices(words, k=rng.randint(1, 3))), f"v{i}") for i in range(25)] + [(30, "--", "blank"), (31, "unodos", "none")]
    base, table = frame(spark, "_ord long, t string", texts), frame(spark, "_ord long, k string, v string", keys)
    found = lookup.phrase_table(table, "k", ["v"])
    for several in Several:
        one, two = (sorted(map(tuple, lookup.phrase_lookup(base, "t", found, several, grams=g).collect()), key=str) for g in (True, False))
        assert one == two and len(one) == 150
        shuffled = lookup.phrase_lookup(base, "t", found, several, grams=True, sent_bytes=0)
        assert sorted(map(tuple, shuffled.collect()), key=str) == one
    hits = {r._ord: r.v for r in lookup.phrase_lookup(base, "t", found, Several.FIRST).collect()}
    for i, t in texts:
        own = [v for _, k, v in keys if k in words or " " in k if f" {k} " in f" {t or ''} "]
        assert hits[i] == (own[0] if own else "")


def test_exact_lookup_policies(spark):
    table = frame(spark, "_ord long, k string, v string", [(0, "A", None), (1, "a", "x"), (2, "", "y"), (3, "b", "z")])
    base = frame(spark, "k string, v string", [("á", "1"), ("B!", "2"), ("", "3"), (None, "4")])
    first = lookup.exact_lookup(base, "k", lookup.exact_table(table, "k", ["v"]))
    assert first.columns == ["v_tabla", "k", "v"] and {r.v: r.v_tabla for r in first.collect()} == {"1": "", "2": "z", "3": "", "4": ""}
    every = lookup.exact_lookup(base, "k", lookup.exact_table(table, "k", ["v"], every=True), matched_only=True)
    assert {r.v: r.v_tabla for r in every.collect()} == {"1": "\nx", "2": "z"}


def test_delete_with_shift(spark):
    data = [(0, "bad", " a ", "b"), (1, " keep ", None, ""), (2, "bad", "BAD", "badly"), (3, "bad", " ", None), (4, None, "bad", "z")]
    df = frame(spark, "_ord long, a string, b string, c string", data)
    kept, gone = rows.delete_words(df, ["a", "b", "c", "missing"], ["bad"])
    assert {r._ord: (r.a, r.b, r.c) for r in kept.collect()} == {0: ("a", "b", ""), 1: (" keep ", None, ""), 4: ("z", "", "")}
    reasons = {r._ord: r.Motivo_Borrado for r in gone.collect()}
    assert set(reasons) == {2, 3} and "contienen" in reasons[2] and "vacías" in reasons[3]
    same, none = rows.delete_words(df, ["missing"], ["bad"])
    assert same.count() == 5 and none.count() == 0


def test_order_is_independent_of_splits(spark):
    values = ["10", "2", " 5. ", "-1e1", "b", "A", "á", "nan", "", None, "\t", "2", "1_000", "zz", "Z"]
    expected = None
    for partitions in (1, 5, 15):
        df = frame(spark, "_ord long, v string", list(enumerate(values)), partitions)
        for up in (True, False):
            ranked = order.number_rows(df, [*order.sheet_order("v", up), F.col("_ord").asc()])
            found = [r._ord for r in sorted(ranked.collect(), key=lambda r: r["rank"])]
            assert found == [r._ord for r in order.sort_sheet(df, "v", up).collect()]
            assert set(found[-3:]) == {8, 9, 10}
            if up:
                expected = expected or found
                assert found == expected
    assert expected[:5] == [3, 1, 11, 2, 0]


def test_splits_lose_nothing(spark):
    df = spark.range(100).withColumn("x", F.col("id") % 7)
    valid, removed = rows.split_by_reason(df, [(F.col("x") == 1, "one"), (F.col("x") < 3, "low")])
    assert valid.count() + removed.count() == 100
    assert {(r.x, r.Motivo_Eliminacion) for r in removed.collect()} == {(0, "low"), (1, "one"), (2, "low")}
    short, long = rows.split_by_length(frame(spark, "t string", [("a" * n,) for n in range(9)] + [(None,)]), "t", 4)
    assert (short.count(), long.count()) == (6, 4)


def test_combine(spark):
    one = frame(spark, "_ord long, A string, B string", [(0, "1", "null"), (1, None, " ")])
    two = frame(spark, "_ord long, A string, C string", [(0, "10", "Ã±")])
    found = combine.combine([one, two], combine.CombineOptions(sort_column="A"))
    assert [(r.A, r.B, r.C) for r in found.collect()] == [("1", "", ""), ("10", "", "ñ"), ("", " ", "")]
    parts = combine.combine([one, two], combine.CombineOptions(division=combine.Division.FILES, rows_each=2))
    assert sorted(r._part for r in parts.collect()) == [1, 1, 2]
    for bad in (combine.CombineOptions(sort_column="Z"), combine.CombineOptions(division=combine.Division.SHEETS, fmt="csv")):
        with pytest.raises(ValueError):
            combine.combine([one], bad)
    for name in ("a/b", "..", "con.txt", ""):
        with pytest.raises(ValueError):
            combine.check_output_name(name)


def test_title_cascade(spark):
    words = titles.Vocabulary(brands=["acme"], critical=["pro"], forbidden=["bad word"])
    cases = {
        "This has a Bad Word inside of it now": ("This has a Bad Word inside of it now", "Palabra prohibida(Bad Word)"),
        "ACME, (Pro) bracket for the left side of the engine..": ("bracket for the left side of the engine", None),
        "Bracket 123456 for the left side of it": ("Bracket 123456 for the left side of it", titles.SIX_DIGITS),
        "short": ("short", "Longitud fuera de rango: 5 caracteres"),
        "x" * 61: ("x" * 61, "Longitud fuera de rango: 61 caracteres"),
        "Part 12345 12345 12345 bracket of steel": ("Part 12345 12345 12345 bracket of steel", titles.RULE_4),
        "Part 1234-5678/90 bracket of steel here": ("Part 1234-5678/90 bracket of steel here", titles.RULE_1),
        "Part AB123.45C67D bracket of steel here": ("Part AB123.45C67D bracket of steel here", titles.RULE_2),
        "Bracket of steel 301 3022 333 for pumps": ("Bracket of steel 301 3022 333 for pumps", titles.RULE_3),
        "Bracket of steel 1.5 2.5/3.5 4.5 sizes": ("Bracket of steel 1.5 2.5/3.5 4.5 sizes", titles.RULE_5),
        "Bracket of a1b2 c345 d678 e901 sizes of": ("Bracket of a1b2 c345 d678 e901 sizes of", titles.RULE_6),
        "_x000D_Bracket of​ steel  for the long pump\n": ("Bracket of steel for the long pump", None),
    }
    df = frame(spark, "t string", [(t,) for t in cases])
    found = titles.judge_titles(df.withColumn("o", F.col("t")), "t", words).collect()
    assert {r.o: (r.t, r.Motivo_Eliminacion) for r in found} == cases


def test_validate_needs_titles_and_free_names(spark):
    with pytest.raises(ValueError):
        titles.validate(frame(spark, "x string, _sheet string, _ord long", [("a", "s", 1)]), titles.Vocabulary())
    with pytest.raises(ValueError):
        titles.validate(frame(spark, "Traducido string, OEM3 string, _sheet string, _ord long", [("a", "b", "s", 1)]), titles.Vocabulary())


def test_features_and_quantity(spark):
    df = frame(spark, "t string", [("Front Left upper PAIR kit",), ("front rear RH",), ("",), (None,), ("set of 4pcs",)])
    assert [tuple(r) for r in df.select(listing.features("t"), listing.quantity("t")).collect()] == [("Frontal Izq Superior ", "Kit"), ("Der ", ""), ("", ""), ("", ""), ("", "Set")]


def test_compatibility_routes_hold_every_product(spark):
    products = spark.createDataFrame(
        [(i, f"u{i}", "$9.50", "" if i != 3 else "Red", "Shop", "http://i/a.jpg" if i != 4 else "video") for i in range(6)],
        "_ord long, `web-scraper-start-url` string, Precio string, Opcion string, Tienda string, `Imagen 1` string",
    )
    lists = ["A-1-2@ERROR x@B NA NA@" + "y" * 70, "", "A-1-2", None]
    sheets = spark.createDataFrame([(i, f"u{i}", v) for i, v in enumerate(lists)], "_ord long, `web-scraper-start-url` string, Coincidencia string")
    routes = listing.compatibility(products, sheets, [listing.Bracket(1, 50, 100)], listing.Mode.COMPRESSED)
    text = lambda name: sorted(r.Combinada for r in routes[name].collect() if r.Combinada is not None)
    assert text("Procesadas") == ["A 1-2"] and routes["Duplicadas"].count() == 1
    assert [len(t) for t in text("Exceso_caracteres")] == [70]
    assert text("Eliminadas") == ["B NA NA", "ERROR x"] and routes["Eliminadas"].count() == 4
    assert sorted(r._ord for r in routes["No_Procesadas"].collect()) == [1, 5]
    assert "Precio" not in routes["Procesadas"].columns and "Precio" in routes["Eliminadas"].columns


def test_verdicts(spark):
    df = spark.createDataFrame([(10, "http://x/a.jpg", "http://x/b.jpg"), (11, "http://x/c.jpg", None)], "_ord long, a string, b string")
    verdicts = spark.createDataFrame([(10, "a", False, "dark"), (11, "a", False, "dark"), (10, "z", False, "other")], "idx long, col string, approved boolean, reason string")
    found = {r._ord: r for r in cells.apply_verdicts(df, ["a", "b"], verdicts).collect()}
    assert (found[10].a, found[10].b, found[10]._imagen_motivo) == ("", "http://x/b.jpg", "[a] dark")
    assert found[11]._imagen_aprobada and found[11]._tiene_rechazada
    assert cells.approved_rows(cells.apply_verdicts(df, ["a", "b"], verdicts), ["a", "b"]).where("_ord = 10").first().a == "http://x/b.jpg"
    tasks = cells.embed_tasks(spark.createDataFrame([(1, "http://x/a.jpg,http://x/b.jpg", "http://x/c.png"), (2, "", "http://x/d.png")], "_ord long, u string, w string"), ["u", "w"])
    assert {(r["col"], r.original, r.k, r.final) for r in cells.embed_layout(tasks, ["u", "w"]).collect()} == {("u", 0, 2, 0), ("w", 1, 1, 3)}
