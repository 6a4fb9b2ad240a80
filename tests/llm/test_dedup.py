import hashlib
import random

import numpy as np
import pytest
import xxhash

from lonja.llm import components, line_dedup, simhash, substring_dedup, tables


# Repeated substrings


def substrings_by_hand(rows, window):
    seen, out = set(), {}
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        words = (text or "").encode().split()
        covered = [False] * len(words)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            if key in seen:
                covered[i : i + window] = [True] * window
            seen.add(key)
        kept = [w for w, c in zip(words, covered, strict=True) if not c]
        out[doc] = (len(words), sum(covered), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


@pytest.mark.parametrize(("window", "seed"), [(20, 8), (6, 3), (3, 2), (2, 1)])
def test_substrings_equal_brute_force(make_docs, scratch, corpus, window, seed):
    rows = corpus + [(None, dict(corpus)[50])]
    found = substring_dedup.digest(substring_dedup.remove_repeats(make_docs(rows), scratch, window, seed)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == substrings_by_hand(rows, window) and len(found) == len(rows)


def test_substrings_of_random_texts(make_docs, scratch):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcd", k=rng.randint(0, 60)))) for i in range(80)]
    found = substring_dedup.digest(substring_dedup.remove_repeats(make_docs(rows), scratch, 5, 2)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in found} == substrings_by_hand(rows, 5)


def test_substrings_of_repeated_rows_and_empty_table(make_docs, scratch, corpus):
    rows = [(1, dict(corpus)[30]), (1, dict(corpus)[30]), (2, dict(corpus)[30])]
    found = sorted((r.doc_id, r.n_removed) for r in substring_dedup.remove_repeats(make_docs(rows), scratch).collect())
    assert found == [(1, 0), (1, 0), (2, 200)]
    assert substring_dedup.remove_repeats(make_docs([]), scratch).count() == 0


def test_substrings_of_rows_that_share_an_id(make_docs, scratch):
    passage = " ".join(f"p{i}" for i in range(20))
    for shared in (None, 7):
        rows = [(shared, passage), (shared, passage + " and the end"), (shared, " ".join(f"q{i}" for i in range(60)) + " " + passage), (8, passage + " last")]
        found = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(make_docs(rows), scratch).collect()]
        assert sorted(n for _, n, _ in found) == [20, 21, 23, 80] and (8, 21, 20) in found
        assert sorted(gone for doc, _, gone in found if doc == shared) == [0, 20, 20]
    found = [(r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(make_docs([(None, passage), (None, passage), (1, "few words")]), scratch).collect()]
    assert sorted(found) == [(2, 0), (20, 0), (20, 20)]


def test_span_hashes_depend_on_content_alone():
    words = b"a b c d a b c d e".split()
    rolling = substring_dedup.Rolling(words)
    for which in (0, 1):
        one, two, three = (int(rolling.span(np.array([s]), np.array([s + 4]), which)[0]) for s in (0, 4, 1))
        assert one == two != three


# SimHash


def fingerprint_by_hand(text, n=3):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def classes_by_hand(rows, radius):
    nodes = [(doc, fingerprint_by_hand(text)) for doc, text in rows]
    parent = list(range(len(nodes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if (nodes[i][1] ^ nodes[j][1]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(nodes):
        if doc is not None:
            least[root(i)] = min(least.get(root(i), doc), doc)
    return sorted((repr(doc), f"{fp:016x}", least.get(root(i))) for i, (doc, fp) in enumerate(nodes))


@pytest.mark.parametrize("radius", [0, 3, 9])
def test_simhash_equals_brute_force(make_docs, scratch, corpus, radius):
    rows = corpus + [(None, dict(corpus)[30]), (None, "alone in the world of words"), (31, dict(corpus)[31])]
    found = simhash.near_duplicates(make_docs(rows), scratch, radius=radius).collect()
    assert sorted((repr(r.doc_id), r.fingerprint, r.component_id) for r in found) == classes_by_hand(rows, radius)


def test_fingerprint_in_blocks(monkeypatch):
    text = "The quick Brown fox ÉÈ jumps over " * 40
    monkeypatch.setattr(simhash, "_BLOCK", 7)
    assert simhash.fingerprint(text) == fingerprint_by_hand(text)


def linked(pairs, nodes):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in pairs:
        parent[root(a)] = root(b)
    groups = {}
    for n in nodes:
        groups.setdefault(root(n), set()).add(n)
    return sorted(map(sorted, groups.values()))


def test_hot_bands_are_cut_into_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_TILE", 16)
    rng = random.Random(6)
    base = rng.getrandbits(64)
    values = {base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    nodes = [v - (1 << 64) if v >> 63 else v for v in values]
    expected = linked([(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 3 or a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= 3], nodes)
    for slice_rows in (2048, 40):
        found = simhash.links(spark.createDataFrame([(n, n) for n in nodes], "node long, fp long").repartition(3), 3, slice_rows).collect()
        assert linked([(r.u, r.v) for r in found], nodes) == expected


def test_keep_one(make_docs, scratch, corpus):
    docs = make_docs(corpus + [(None, "no id")])
    kept = simhash.keep_one(docs, scratch)
    ids = [r.doc_id for r in kept.collect()]
    # Exact copies, near copies (one word of two hundred changed) and texts of one shingle leave their first; others stay.
    gone = {31, 32, 33, 40, 41, 42, 43, 44, 45, 61, 64, 65}
    assert kept.columns == docs.columns and set(ids) == {i for i, _ in corpus} - gone | {None} and len(ids) == len(set(ids))
    assert simhash.keep_one(make_docs([]), scratch).count() == 0


def test_keep_one_of_rows_that_share_ids(make_docs, scratch):
    text, other = "the river runs by the stone house under great light", "a wholly different text of some words that stands alone"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (None, other), (None, other), (3, None), (3, ""), (None, " ")]
    kept = sorted(((r.doc_id, r.text) for r in simhash.keep_one(make_docs(rows), scratch).collect()), key=str)
    assert len(kept) == 3 and (1, text) in kept and (None, other) in kept and sum(i == 3 for i, _ in kept) == 1


def jaccard(a, b, n=5):
    one, two = ({tuple(t.split()[i : i + n]) for i in range(max(1, len(t.split()) - n + 1))} for t in (a, b))
    return len(one & two) / len(one | two)


def test_sketch_follows_similarity():
    rng = random.Random(21)
    base = [f"w{rng.randrange(5000)}" for _ in range(400)]
    limit = simhash.sketch_limit(0.8)
    near = far = 0
    for edits in range(1, 40):
        other = list(base)
        for at in rng.sample(range(400), edits):
            other[at] = f"x{at}"
        one, two = (np.frombuffer(simhash.sketch(" ".join(t)), np.uint64) for t in (base, other))
        distance, similarity = int(np.bitwise_count(one ^ two).sum()), jaccard(" ".join(base), " ".join(other))
        near += similarity >= 0.88
        far += similarity <= 0.7
        assert distance <= limit if similarity >= 0.88 else True
        assert distance > limit if similarity <= 0.7 else True
    assert near > 3 and far > 10
    assert simhash.sketch(None) == simhash.sketch(" ") == bytes(64)


def test_similar_pairs_equal_brute_force(make_docs, scratch):
    rng = random.Random(33)
    texts = []
    for _ in range(60):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randint(150, 500))]
        for share in (0.0, 0.02, 0.025, 0.03):
            other = list(base)
            for at in rng.sample(range(len(base)), round(share * len(base))):
                other[at] = f"x{rng.randrange(10**6)}"
            texts.append(" ".join(other))
    common = [f"c{i}" for i in range(200)]
    for i in range(40):
        texts.append(" ".join([*common[: 150 + i], *(f"y{i}z{j}" for j in range(12))]))
    rows = list(enumerate(texts))
    scores = {(a, b): jaccard(texts[a], texts[b]) for a in range(len(rows)) for b in range(a) if a // 4 == b // 4 or b >= 240}
    assert sum(0.75 <= x < 0.8 for x in scores.values()) > 20 < sum(0.8 <= x <= 0.85 for x in scores.values())
    expected = linked([p for p, x in scores.items() if x >= 0.8], range(len(rows)))
    for slice_rows in (2048, 10):
        found = {r.doc_id: r.component_id for r in simhash.similar_groups(make_docs(rows), scratch, slice_rows=slice_rows).collect()}
        assert found == {n: group[0] for group in expected for n in group}


def test_components_of_random_graphs(spark, scratch):
    rng = random.Random(12)
    pairs = [(rng.randrange(120), rng.randrange(120)) for _ in range(90)] + [(i, i + 1) for i in range(200, 260)] + [(500, i) for i in range(300, 400)] + [(7, 7)]
    found = components.components(spark.createDataFrame(pairs, "u long, v long"), scratch, "random").collect()
    nodes = sorted({n for p in pairs for n in p})
    assert linked([(r.node, r.root) for r in found], nodes) == linked(pairs, nodes)
    assert all(r.root < r.node for r in found)
    assert components.components(spark.createDataFrame([], "u long, v long"), scratch, "none").count() == 0


# Lines


def within_one(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) <= 1
    a, b = sorted((a, b), key=len)
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :]


def lines_by_hand(rows, least):
    places = sorted((d if d is not None else -(1 << 63), n, line, d) for d, t in rows if t is not None for n, line in enumerate(t.split("\n")) if len(line) >= least)
    gone = {}
    for k, (key, n, line, doc) in enumerate(places):
        if any(within_one(line, other) for o, m, other, _ in places[:k] if (o, m) < (key, n)):
            gone.setdefault(doc, []).append(n)
    return {d: (len(t.split("\n")) if t is not None else 0, gone.get(d, [])) for d, t in rows}


def test_lines_equal_brute_force(make_docs, scratch):
    rng = random.Random(3)
    base = ["".join(rng.choices("abé ", k=rng.randint(0, 14))) for _ in range(25)]
    rows = []
    for doc in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            line = list(rng.choice(base))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(line) + 1)
                line[at : at + rng.randrange(2)] = rng.choice(["", "x", "a"])
            lines.append("".join(line))
        rows.append((doc, "\n".join(lines)))
    rows += [(100, None), (101, ""), (None, base[0] + "\n" + base[1]), (102, "q" * 400), (103, "q" * 401 + "\n" + "q" * 399), (104, "aaaaaaaaaa\naaaaaaaaaaa\nbaaaaaaaaa")]
    for least in (0, 1, 10):
        docs = make_docs(rows)
        removed = line_dedup.removed_lines(docs, scratch, least)
        found = line_dedup.line_report(docs, removed).collect()
        assert {r.doc_id: (r.n_lines, list(r.removed)) for r in found} == lines_by_hand(rows, least)
        assert all(r.n_removed == len(r.removed) for r in found) and len(found) == len(rows)
    texts = {r.doc_id: r.text for r in line_dedup.drop_lines(docs, removed).collect()}
    expected = lines_by_hand(rows, 10)
    for doc, text in rows:
        assert texts[doc] == (None if text is None else "\n".join(line for n, line in enumerate(text.split("\n")) if n not in expected[doc][1]))


def test_lines_by_bytes_equal_brute_force(make_docs, scratch):
    rng = random.Random(5)
    base = ["".join(rng.choices("abéèñ日", k=rng.randint(0, 5))) for _ in range(25)]
    rows = [(doc, "\n".join("".join(rng.choices("abéèñ日", k=1) + list(rng.choice(base)))[rng.randrange(2) :] for _ in range(rng.randint(0, 6)))) for doc in range(40)]
    rows += [(100, None), (101, ""), (102, "Are. and more\nÉre. and more\nère. and more"), (103, "一" * 200 + "\n" + "一" * 199 + "丁\n" + "一" * 199)]

    def found(docs, **options):
        return {r.doc_id: (r.n_lines, list(r.removed)) for r in line_dedup.line_report(docs, line_dedup.removed_lines(docs, scratch, **options)).collect()}

    as_bytes = [(d, t if t is None else t.encode().decode("latin-1")) for d, t in rows]
    docs = make_docs(rows)
    by_bytes = found(docs, by_bytes=True)
    assert by_bytes == lines_by_hand(as_bytes, 0) != found(docs) == lines_by_hand(rows, 0)
    assert by_bytes[102] == (3, [2]) and by_bytes[103] == (3, [1])
    docs = make_docs([(1, "éééééé\néééééé\nééééééaaaa\nééééééaaaa")])
    assert found(docs, by_bytes=True, least_chars=10) == {1: (4, [3])}


def test_lines_use_no_python(make_docs, scratch):
    docs = make_docs([(1, "a line of text here\na line of text here"), (2, "a line of text here!")])
    removed = line_dedup.removed_lines(docs, scratch)
    assert sorted((r.doc_id, r.line_no) for r in removed.collect()) == [(1, 1), (2, 0)]
    plan = line_dedup._variants(docs.selectExpr("1L h1", "2L h2", "struct(doc_id, 1 as line_no) place", "char_length(text) n", "text line", "true first_half", "true last_half"))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text


def test_lines_of_empty_table_and_repeated_rows(make_docs, scratch):
    empty = make_docs([])
    assert line_dedup.line_report(empty, line_dedup.removed_lines(empty, scratch)).count() == 0
    docs = make_docs([(1, "the same long line"), (1, "the same long line")])
    assert line_dedup.removed_lines(docs, scratch).count() == 0


def test_lines_of_rows_that_share_an_id(make_docs, scratch):
    line, near = "a line that is repeated", "a line that is repeatee"
    for shared in (None, 7):
        docs = tables.numbered(make_docs([(shared, line), (shared, near), (shared, "another line altogether\n" + line), (8, near + "\nunique words of its own")]), scratch)
        found = line_dedup.line_report(docs, line_dedup.removed_lines(docs, scratch)).collect()
        assert sorted((r.n_lines, r.n_removed) for r in found if r.doc_id == shared) in ([(1, 0), (1, 1), (2, 1)], [(1, 1), (1, 1), (2, 0)])
        assert [list(r.removed) for r in found if r.doc_id == 8] == [[0]] and len(found) == 4
    docs = tables.numbered(make_docs([(None, line), (None, line)]), scratch)
    found = line_dedup.line_report(docs, line_dedup.removed_lines(docs, scratch)).collect()
    assert sorted((r.doc_id, r.n_removed) for r in found) == [(None, 0), (None, 1)]
