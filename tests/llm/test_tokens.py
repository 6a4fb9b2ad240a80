import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lonja.llm import bpe, token_counts, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", "é", "ñ", " ", "  ", "\n", "\n\n", ".", ",", "1", "'s", " ", "日", "<|endoftext|>", "\t", "foo", "bar.", "|", "²", "_", "\r\n", "ª", "Word", " the"]


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(11)
    return ["", "one", "two words.\nnext line", *["".join(rng.choices(PIECES, k=rng.randint(0, 14))) for _ in range(4000)]]


def test_encoder_equals_whole_text_encoding(tokenizer):
    found = [(ids, n) for _, _, n, ids in bpe.Encoder(PATH).encode(pa.array(texts()))]
    split = [own for ids, n in found for own in np.split(ids, np.cumsum(n)[:-1])]
    for text, own in zip(texts(), split, strict=True):
        assert own.tobytes() == np.asarray(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), text


def test_spans_equal_offsets(tokenizer):
    for text, (begin, end) in zip(texts(), bpe.Encoder(PATH).spans(pa.array(texts())), strict=True):
        assert list(zip(begin.tolist(), end.tolist(), strict=True)) == tokenizer.encode(text, add_special_tokens=False).offsets, text


@pytest.mark.parametrize("size", [1, 40, 1000])
def test_groups_cover_all_texts(size):
    some = pa.array(["a b", None, "", "a much longer text, of several words", " x", "b a b", "y"])
    spans = list(bpe.groups(some, size))
    assert [i for a, b in spans for i in range(a, b)] == list(range(len(some)))
    assert not list(bpe.groups(some.slice(0, 0), size))


def test_files(spark, tmp_path, make_docs, corpus, tokenizer):
    rows = corpus + [(5, dict(corpus)[5]), (5, dict(corpus)[5]), (None, "no id"), (-3, "first"), (10**12, "last")]
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(make_docs(rows), path, PATH, end_id=0, ranges=5)
    found = token_files.token_digest(spark, path).collect()
    expected, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*(tokenizer.encode(text, add_special_tokens=False).ids if text else []), 0]
        expected.append((doc, start, len(ids), zlib.crc32(np.asarray(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in found), key=lambda r: r[1]) == expected


def test_file_format_is_as_described(spark, tmp_path, make_docs, corpus):
    path = tmp_path / "ids"
    token_files.write_token_files(make_docs(corpus * 3), f"file://{path}", PATH, ranges=1)
    file = pq.ParquetFile(next(path.glob("*.parquet")))
    by_name = {file.metadata.row_group(0).column(i).path_in_schema: file.metadata.row_group(0).column(i) for i in range(file.metadata.num_columns)}
    ids = next(v for k, v in by_name.items() if k.startswith("ids"))
    assert "RLE_DICTIONARY" in ids.encodings and "DELTA_BINARY_PACKED" in by_name["doc_id"].encodings
    assert ids.has_offset_index and by_name["doc_id"].has_column_index


def test_metadata_reads_leave_ids_alone(spark, tmp_path, make_docs, corpus):
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(make_docs(corpus), path, PATH)
    plan = token_files.read_tokens(spark, path).select("doc_id", "start")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in "".join(re.findall(r"ReadSchema: struct<([^\n]*)", plan))


def test_empty_table(spark, tmp_path, make_docs):
    path = f"file://{tmp_path}/ids"
    token_files.write_token_files(make_docs([]), path, PATH)
    assert token_files.token_digest(spark, path).count() == 0


def sections_by_hand(tokenizer, text, spans, rule):
    counts, gap = [0] * len(spans), 0
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        held = [(min(b, e) - max(a, s), -i) for i, (s, e) in enumerate(spans) if min(b, e) > max(a, s)]
        if not held:
            gap += 1
            continue
        chosen = {"largest": -max(held)[1], "first": -max(x[1] for x in held), "last": -min(x[1] for x in held)}[rule]
        counts[chosen] += 1
    return counts, gap


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_allocation_equals_brute_force(tokenizer, rule):
    rng = random.Random(2)
    finder = bpe.Encoder(PATH)
    for _ in range(150):
        text = "".join(rng.choices(["hello", " world", "é", "\n", "abc", "."], k=rng.randint(0, 30)))
        cuts = sorted(rng.choices(range(len(text) + 1), k=rng.randint(0, 8)))
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if rng.random() < 0.8]
        begin, end = np.array([a for a, _ in spans], np.int64), np.array([b for _, b in spans], np.int64)
        counts, _, gap = token_counts.allocate(*next(finder.spans(pa.array([text]))), begin, end, rule)
        assert (counts.tolist(), gap) == sections_by_hand(tokenizer, text, spans, rule)


def crossing_by_hand(tokenizer, text, spans, rule):
    """Tokens of each span, tokens of each that also reach into another one, and tokens of none."""
    counts, gap = sections_by_hand(tokenizer, text, spans, rule)
    crossing = [0] * len(spans)
    for a, b in tokenizer.encode(text, add_special_tokens=False).offsets:
        held = [(min(b, e) - max(a, s), -i) for i, (s, e) in enumerate(spans) if min(b, e) > max(a, s)]
        if len(held) > 1:
            crossing[{"largest": -max(held)[1], "first": -max(x[1] for x in held), "last": -min(x[1] for x in held)}[rule]] += 1
    return counts, crossing, gap


def line_spans(text):
    """A line with its line break."""
    spans, at = [], 0
    for line in text.splitlines(keepends=True) if "\n" in text else [text]:
        spans.append((at, at + len(line)))
        at += len(line)
    return spans + ([(at, at)] if text.endswith("\n") else [])


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_sections_of_documents(make_docs, corpus, tokenizer, rule):
    rows = corpus + [(200, "a\n\n\n  b\n   \nword\n"), (201, "\n"), (202, "x\n" * 40), (203, "日本\n語\n\n\n")]
    found = token_counts.section_tokens(make_docs(rows), PATH, rule).collect()
    per_doc = {}
    for r in found:
        per_doc.setdefault(r.doc_id, []).append(tuple(r)[1:])
    crossings = 0
    for doc, text in rows:
        spans = line_spans(text) if text else []
        counts, crossing, gap = crossing_by_hand(tokenizer, text or "", spans, rule)
        total = len(tokenizer.encode(text or "", add_special_tokens=False).ids)
        expected = [(i, a, b, counts[i], crossing[i], total, gap) for i, (a, b) in enumerate(spans)]
        assert sorted(per_doc.get(doc, [])) == expected
        crossings += sum(crossing)
    assert crossings


@pytest.mark.parametrize("rule", token_counts.RULES)
def test_fields(spark, tokenizer, rule):
    values = [(1, "a title", "body text here", None), (2, None, "", "x"), (2, None, "", "x"), (3, "ends ", "  begins", "\n\n"), (None, "", "", "")]
    rows = spark.createDataFrame(values, "k int, title string, body string, note string")
    names = ["title", "body", "note"]
    found = [tuple(r) for r in token_counts.field_tokens(rows, "k", names, PATH, rule).collect()]
    expected = []
    for key, *fields in values:
        texts = [x or "" for x in fields]
        ends = [sum(len(t) + 1 for t in texts[: i + 1]) for i in range(3)]
        spans = [(e - len(t) - 1, e) for e, t in zip(ends, texts, strict=True)]
        spans[-1] = (spans[-1][0], spans[-1][1] - 1)
        counts, crossing, _ = crossing_by_hand(tokenizer, "\n".join(texts), spans, rule)
        expected += [(key, n, a, b) for n, a, b in zip(names, counts, crossing, strict=True)]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_unknown_rule(make_docs):
    with pytest.raises(ValueError):
        token_counts.section_tokens(make_docs([]), PATH, rule="most")
