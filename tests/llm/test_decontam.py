import random

from lonja.llm import decontam


def distance_in(pattern, text):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        last, row = row, [i] + [0] * len(text)
        for j, t in enumerate(text, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (p != t))
    return min(row)


def test_myers_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        pattern = "".join(rng.choices("abc", k=rng.randint(1, 90)))
        text = "".join(rng.choices("abc", k=rng.randint(0, 120)))
        node = decontam.Node(pattern, 0, len(pattern), 0, None)
        best, end = node.search(text)
        assert best == distance_in(pattern, text)
        if best < len(pattern):
            assert distance_in(pattern, text[:end]) == best


def edited(rng, item, edits):
    chars = list(item)
    for _ in range(edits):
        at = rng.randrange(len(chars))
        kind = rng.randrange(3)
        if kind == 0:
            chars[at] = "#"
        elif kind == 1:
            del chars[at]
        else:
            chars.insert(at, "#")
    return "".join(chars)


def test_pigeonhole_loses_nothing_within_the_budget(spark, make_docs):
    rng = random.Random(4)
    items = [(i, "".join(rng.choices("abcdefgh ", k=rng.randint(40, 160))).strip()) for i in range(12)]
    rows, n = [], 0
    for _, text in items:
        size = len(decontam.normalise(text))
        for edits in (0, 1, size // 20, size // 10, size // 5):
            noise = "".join(rng.choices("abcdefgh ", k=200))
            rows.append((n, noise + " " + edited(rng, text, edits) + " " + noise))
            n += 1
    rows += [(900, None), (901, ""), (902, "clean text of no item")]
    bench = spark.createDataFrame([*items, (50, None), (51, "short"), (52, ""), (0, items[0][1])], "item_id long, text string")
    for block in (decontam.BLOCK_CHARS, 200):
        found = {(r.doc_id, r.item_id): r.edits for r in decontam.contaminated(make_docs(rows), bench, 0.1, block_chars=block).collect()}
        for doc, text in rows:
            for item, pattern in items:
                pattern = decontam.normalise(pattern)
                least = distance_in(pattern, decontam.normalise(text))
                assert ((doc, item) in found) == (least <= int(0.1 * len(pattern)))
                if (doc, item) in found:
                    assert found[doc, item] == least


def test_case_and_spaces_do_not_hide_an_item(spark, make_docs):
    bench = spark.createDataFrame([(1, "What is the capital of the northern province?")], "item_id long, text string")
    docs = make_docs([(1, "Q: what  IS the\ncapital of the northern\tprovince? A: none"), (2, "what is the capital")])
    assert [(r.doc_id, r.edits) for r in decontam.contaminated(docs, bench).collect()] == [(1, 0)]


def test_edits_are_the_least_in_periodic_texts():
    rng = random.Random(8)
    for _ in range(300):
        unit = "a" + "".join(rng.choices("ab ", k=rng.randint(2, 5)))
        item = decontam.normalise((unit * 40)[: rng.randint(20, 70)])
        text = decontam.normalise("".join(edited(rng, item, rng.randint(0, 4)) for _ in range(3)))
        budget = int(0.1 * len(item))
        found = decontam.Matcher([(1, item)], 0.1).find(text)
        least = distance_in(item, text)
        if budget:
            assert (0 in found) == (least <= budget) and (not found or found[0][0] == least)


def test_short_items_are_found_as_whole_words(spark, make_docs):
    bench = spark.createDataFrame([(1, "The answer is 42"), (2, "ion"), (3, "x"), (4, " ")], "item_id long, text string")
    docs = make_docs([(1, "so the answer is 42."), (2, "a nation"), (3, "an ion, charged"), (4, "ion"), (5, "x-ray"), (6, "xx"), (7, "the answer is 43")])
    found = {(r.doc_id, r.item_id, r.edits) for r in decontam.contaminated(docs, bench).collect()}
    assert found == {(1, 1, 0), (3, 2, 0), (4, 2, 0), (5, 3, 0), (7, 1, 1)}
    assert {r.doc_id for r in decontam.contaminated(docs, bench, least_chars=10).collect()} == {1, 7}


def test_each_row_is_judged_by_its_own_text(spark, make_docs):
    bench = spark.createDataFrame([(1, "what is the capital of the northern province"), (2, "which river runs by the stone house")], "item_id long, text string")
    docs = make_docs([(None, "which river runs by the stone house"), (None, "clean"), (7, "what is the capital of the northern province"), (7, "clean too"), (8, None)])
    for block in (decontam.BLOCK_CHARS, 10):
        kept = decontam.keep_clean(docs, bench, block_chars=block).collect()
        assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted([(None, "clean"), (7, "clean too"), (8, None)], key=str)


def test_stage_keeps_clean_rows_and_columns(spark, make_docs, corpus):
    bench = spark.createDataFrame([(1, dict(corpus)[30][:150])], "item_id long, text string")
    docs = make_docs(corpus + [(None, "a row without id")])
    kept = decontam.keep_clean(docs, bench)
    gone = {i for i, t in corpus if t and decontam.normalise(dict(corpus)[30][:150]) in decontam.normalise(t)}
    ids = {r.doc_id for r in kept.collect()}
    assert kept.columns == docs.columns and gone >= {30, 31, 32, 33} and not ids & gone
    assert ids | gone >= {i for i, _ in corpus if i < 30 or i >= 50} and None in ids


def test_empty_tables(spark, make_docs, corpus):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.contaminated(make_docs(corpus), none).count() == 0
    some = spark.createDataFrame([(1, "a benchmark item of some length")], "item_id long, text string")
    assert decontam.contaminated(make_docs([]), some).count() == 0
