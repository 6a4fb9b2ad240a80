"""Every registered query over whole tables with its production parameters; SQL where there is some."""

import hashlib
import zlib
from collections import Counter

import duckdb
import pytest
from test_dedup import lines_by_hand
from tokenizers import Tokenizer

import public_tokenizers
from lonja.llm import decontam
from lonja.llm.line_dedup import line_report, removed_lines
from lonja.llm.queries import BYTE_BPE, ORACLE_SQL, QUERIES
from lonja.llm.store import Scratch
from lonja.llm.tables import numbered, table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def result(spark):
    found = {}

    def get(name):
        if name not in found:
            found[name] = QUERIES[name](spark, SF).collect()
        return found[name]

    return get


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in ("op3_token_counts", "op4_decontamination")])
def test_one_row_for_each_document(result, documents, name):
    assert Counter(r.doc_id for r in result(name)) == Counter(list(documents))


# The edit distance of op8's SQL counts bytes, so it misses one-character edits beyond ASCII; brute force below counts characters.
@pytest.mark.parametrize("name", [n for n in ORACLE_SQL if n != "op8_line_dedup"])
def test_query_equals_sql(result, name):
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
        expected = db.sql(ORACLE_SQL[name])
        columns = sorted(expected.columns)
        by_sql = sorted(repr([round(v, 6) if isinstance(v, float) else v for _, v in sorted(zip(expected.columns, r, strict=True))]) for r in expected.fetchall())
    found = result(name)
    assert sorted(found[0].asDict()) == columns
    assert sorted(repr([round(r[c], 6) if isinstance(r[c], float) else r[c] for c in columns]) for r in found) == by_sql


# At most one edit between two lines, over characters, in the place of the engine's distance over bytes.
_BY_CHARACTER = """
CREATE MACRO levenshtein(a, b) AS CASE WHEN len(list_filter(range(0, least(length(a), length(b)) + 1), lambda p: left(a, p) = left(b, p)
  AND (substr(a, p + 2) = substr(b, p + 2) OR substr(a, p + 2) = substr(b, p + 1) OR substr(a, p + 1) = substr(b, p + 2)))) > 0 THEN 1 ELSE 2 END
"""


def test_lines_equal_sql_over_characters(result):
    with duckdb.connect() as db:
        assert db.sql("select levenshtein('Are.', 'Ére.')").fetchall() == [(2,)]
        db.sql(_BY_CHARACTER)
        assert db.sql("select levenshtein('Are.', 'Ére.'), levenshtein('é', ''), levenshtein('ab', 'ba'), levenshtein('añb', 'ab'), levenshtein('', '')").fetchall() == [(1, 1, 2, 1, 1)]
        db.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
        expected = db.sql(ORACLE_SQL["op8_line_dedup"])
        by_sql = sorted(tuple(r) for r in expected.fetchall())
        columns = expected.columns
    assert sorted(tuple(r[c] for c in columns) for r in result("op8_line_dedup")) == by_sql


def test_lines_equal_sql_over_one_byte_characters(result, documents):
    """With an unused ASCII character for each one beyond ASCII, bytes are characters: SQL and its distance need no change."""
    used = set().union(*(r.text or "" for r in documents.values()))
    beyond = sorted(c for c in used if not c.isascii())
    unused = [chr(c) for c in range(1, 128) if chr(c) not in used | {"\n"}][: len(beyond)]
    assert 0 < len(beyond) == len(unused)
    found = {r.doc_id: (r.n_lines, r.n_removed, r.removed) for r in result("op8_line_dedup")}
    with duckdb.connect() as db:
        db.execute(f"create table documents as select doc_id, translate(text, ?, ?) as text from read_parquet('{SF}/documents.parquet')", ["".join(beyond), "".join(unused)])
        assert {d: tuple(rest) for d, *rest in db.sql(ORACLE_SQL["op8_line_dedup"]).fetchall()} == found
        db.sql(f"create or replace table documents as select * from read_parquet('{SF}/documents.parquet')")
        as_it_is = {d: removed for d, _, _, removed in db.sql(ORACLE_SQL["op8_line_dedup"]).fetchall()}
    assert all(set(as_it_is[d].split(",")) - {""} <= set(removed.split(",")) for d, (_, _, removed) in found.items())


def test_lines_by_bytes_equal_sql(spark):
    """SQL and its distance unchanged: the operator, told to count bytes as that distance does, equals it."""
    docs, scratch = numbered(table(spark, SF, "documents"), Scratch(spark, "lines")), Scratch(spark, "lines")
    found = line_report(docs, removed_lines(docs, scratch, by_bytes=True)).collect()
    with duckdb.connect() as db:
        db.sql(f"create view documents as select * from read_parquet('{SF}/documents.parquet')")
        by_sql = sorted(db.sql(ORACLE_SQL["op8_line_dedup"]).fetchall())
    assert sorted((r.doc_id, r.n_lines, r.n_removed, ",".join(map(str, r.removed))) for r in found) == by_sql


def test_lines_equal_brute_force(result, documents):
    expected = lines_by_hand([(d, r.text) for d, r in documents.items()], 0)
    found = {r.doc_id: (r.n_lines, [int(n) for n in r.removed.split(",") if n]) for r in result("op8_line_dedup")}
    assert found == expected and sum(len(x) for _, x in found.values()) == sum(r.n_removed for r in result("op8_line_dedup"))


def test_media_payloads(result, documents):
    for r in result("op1_ogg"):
        data = (documents[r.doc_id].text or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))


def test_language_of_held_out_documents(result, documents):
    rows = [r for r in result("op2_language_id") if r.held_out]
    assert {r.doc_id for r in rows} == {d for d in documents if zlib.crc32(str(d).encode()) % 5 == 0}
    known = [r for r in rows if documents[r.doc_id].lang is not None and any(c.isalpha() for c in documents[r.doc_id].text or "")]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in known) >= 0.9 * len(known)
    assert all(0 <= r.score <= 1 for r in result("op2_language_id"))


def test_items_held_word_for_word_are_found(spark, result, documents):
    found = {r.doc_id for r in result("op4_decontamination")}
    items = [decontam.normalise(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, r in documents.items() if any(i and i in decontam.normalise(r.text or "") for i in items)}
    assert held <= found <= set(documents)


def test_sections_hold_every_token(result, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    total = Counter()
    for r in result("op3_token_counts"):
        total[r.doc_id] += r.n_tokens
    assert all(total[d] == len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) for d, r in documents.items())


def test_ids_of_the_files(result, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(BYTE_BPE))
    start = 0
    for r in sorted(result("op10_token_files"), key=lambda r: r.doc_id):
        ids = [*tokenizer.encode(documents[r.doc_id].text or "", add_special_tokens=False).ids, 0]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        start += len(ids)
