import random
import zlib
from collections import Counter

from lonja.llm import langid

LANGS = {"en": "the of and with that there which from this have", "de": "der und nicht schon über einen durch ist für auch", "es": "que para los una con más niño después están pero"}


def grams_by_hand(text):
    spaced = " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "
    while "  " in spaced:
        spaced = spaced.replace("  ", " ")
    found = Counter()
    for i in range(len(spaced)):
        for n in (1, 2, 3):
            gram = spaced[i : i + n]
            if len(gram) == n and gram != " " and " " not in gram[1:-1]:
                found[gram] += 1
    return found if any(c != " " for c in spaced) else Counter()


def pack(gram):
    code = 0
    for c in gram:
        code = code << 21 | ord(c)
    return code


def test_grams_equal_a_count_by_hand(monkeypatch):
    rng = random.Random(3)
    texts = ["", " ", "a", "ab cd", "Ünïcödé, 日本 x1y2!", "".join(rng.choice("ab .é\n") for _ in range(4000))]
    for block in (1 << 20, 7):
        monkeypatch.setattr(langid, "_BLOCK", block)
        for text in texts:
            codes, counts = langid.count_grams(text)
            assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == {pack(g): n for g, n in grams_by_hand(text).items()}


def predict_by_hand(profiles, text, size):
    found = sorted(((-n, pack(g)) for g, n in grams_by_hand(text or "").items()))[:size]
    if not found:
        return "und", 0.0
    best = None
    for lang in sorted(profiles, key=str.encode):
        ranks = {g: i for i, g in enumerate(profiles[lang])}
        distance = sum(abs(ranks[g] - i) if g in ranks else size for i, (_, g) in enumerate(found))
        if best is None or distance < best[0]:
            best = (distance, lang)
    return best[1], 1 - best[0] / (size * len(found))


def test_predictions_and_profiles_equal_brute_force(make_docs):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(LANGS[lang].split(), k=rng.randint(1, 60))), lang) for i, lang in enumerate(rng.choices(list(LANGS), k=60))]
    rows += [(100, None, "en"), (101, "123 456", "de"), (102, "über", None), (None, "der und der", "de"), (103, "", "en")]
    docs = make_docs(rows)
    size = 50
    train = [(t, lang) for i, t, lang in rows if i is not None and zlib.crc32(str(i).encode()) % 5 and t and lang]
    profiles = {}
    for lang in {x for _, x in train}:
        total = Counter()
        for text, own in train:
            if own == lang:
                total.update(grams_by_hand(text))
        profiles[lang] = [g for _, g in sorted((-n, pack(g)) for g, n in total.items())[:size]]
    found = langid.identify(docs, size).collect()
    assert len(found) == len(rows)
    texts = {i: t for i, t, _ in rows}
    for r in found:
        lang, score = predict_by_hand(profiles, texts[r.doc_id], size)
        assert r.lang_pred == lang and abs(r.score - score) < 1e-12
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in found) / len(found) > 0.95


def test_empty_table_and_no_labels(make_docs):
    assert langid.identify(make_docs([])).count() == 0
    assert {r.lang_pred for r in langid.identify(make_docs([(1, "abc", None)])).collect()} == {"und"}


def test_accept_keeps_columns_and_clean_rows(make_docs):
    docs = make_docs([(i, LANGS["en"], "en") for i in range(20)] + [(50, "1234 5678", "en"), (51, None, "en")])
    profiles = langid.learn_profiles(docs)
    kept = langid.accept(docs, profiles, 0.2)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(20))
