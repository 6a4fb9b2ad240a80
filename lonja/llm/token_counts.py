"""Token counts of sections by offset-mapped attribution.

Each document is encoded once, as a whole, with the character span of every token. The spans are joined with the
document's sections by interval: both lists are in order, so two binary searches give the sections that a token touches.
A token that touches several is allocated by an explicit rule:

``largest``  to the section that holds most of its characters, the earlier one in a tie (default)
``first``    to the section that holds its first character
``last``     to the section that holds its last character

A token that touches no section (a gap) is counted under ``unassigned``. So the counts of a document always add up to
the number of its tokens, each token once.

Edge cases
    Null or empty text has no tokens; its sections count zero. Sections are half-open character spans, sorted and without
    overlap within a document; empty spans hold nothing. Bytes of one character split over tokens give each of those
    tokens that character's span. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.bpe import encoder
from lonja.llm.tables import pick

RULES = ("largest", "first", "last")
_SLICE = 256


def lines(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Spans of the lines of a text, line breaks left to the line they end."""
    if not text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sizes = np.fromiter((len(x) + 1 for x in text.split("\n")), np.int64)
    sizes[-1] -= 1
    ends = np.cumsum(sizes)
    return ends - sizes, ends


def allocate(token_begin: np.ndarray, token_end: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Tokens and boundary-crossing tokens of each section, and tokens of none."""
    counts, crossing = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    real = np.flatnonzero(end > begin)
    begin, end = begin[real], end[real]
    low = np.searchsorted(end, token_begin, "right")
    high = np.searchsorted(begin, np.maximum(token_end, token_begin + 1), "left") - 1
    touches = low <= high
    crosses = low < high
    chosen = np.where(rule == "last", high, low)
    if rule == "largest" and crosses.any():
        at = np.flatnonzero(crosses)
        best = np.full(len(at), -1)
        for step in range(int((high[at] - low[at]).max()) + 1):
            section = np.minimum(low[at] + step, high[at])
            held = np.minimum(end[section], token_end[at]) - np.maximum(begin[section], token_begin[at])
            better = held > best
            best[better] = held[better]
            chosen[at[better]] = section[better]
    np.add.at(counts, real[chosen[touches]], 1)
    np.add.at(crossing, real[chosen[crosses]], 1)
    return counts, crossing, int((~touches).sum())


def _count(path: str, rule: str, split: Callable[[str | None], tuple[np.ndarray, np.ndarray]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["doc_id", "section", "begin", "end", "n_tokens", "n_crossing", "doc_tokens", "unassigned"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = encoder(path).spans
        for batch in batches:
            rows: list[list[np.ndarray]] = [[] for _ in names[1:]]
            sizes, first = [], 0
            for number, (text, tokens) in enumerate(zip(batch.column("text"), find(batch.column("text")), strict=True), 1):
                begin, end = split(text.as_py())
                counts, crossing, gap = allocate(*tokens, begin, end, rule)
                n = len(begin)
                sizes.append(n)
                for held, x in zip(rows, (np.arange(n), begin, end, counts, crossing, np.full(n, len(tokens[0])), np.full(n, gap)), strict=True):
                    held.append(x)
                if number % _SLICE == 0 or number == batch.num_rows:
                    docs = batch.column("doc_id").slice(first, number - first).take(pa.array(np.repeat(np.arange(number - first), sizes)))
                    yield pa.RecordBatch.from_arrays([docs, *(pa.array(np.concatenate(x), pa.int64()) for x in rows)], names)
                    rows, sizes, first = [[] for _ in names[1:]], [], number

    return run


def section_tokens(docs: DataFrame, tokenizer_path: str, rule: str = "largest", split: Callable[[str | None], tuple[np.ndarray, np.ndarray]] = lines) -> DataFrame:
    """One row per section of ``docs(doc_id, text)``: its span, tokens, boundary-crossing tokens, and the document's totals.

    ``split`` gives the sections of a text as arrays of begins and ends.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    schema = "doc_id long, section long, begin long, end long, n_tokens long, n_crossing long, doc_tokens long, unassigned long"
    return pick(docs, "doc_id", "text").mapInArrow(_count(tokenizer_path, rule, split), schema)


def field_tokens(table: DataFrame, key: str, fields: list[str], tokenizer_path: str, rule: str = "largest") -> DataFrame:
    """Tokens of each named text field when the fields are joined by line breaks and encoded as one document.

    A null field is empty. The breaks belong to the field before them. Returns ``key, field, n_tokens, n_crossing``.
    """
    sizes = [F.coalesce(F.char_length(f"`{f}`"), F.lit(0)).cast("long") for f in fields]
    joined = F.concat_ws("\n", *[F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("")) for f in fields])
    source = table.select(F.col(f"`{key}`").cast("string").alias("key"), joined.alias("text"), F.array(*sizes).alias("sizes"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = encoder(tokenizer_path).spans
        for batch in batches:
            keys, names, counts, crossings = [], [], [], []
            for own, widths, tokens in zip(batch.column("key").to_pylist(), batch.column("sizes").to_pylist(), find(batch.column("text")), strict=True):
                end = np.cumsum(np.array(widths) + 1)
                begin = end - np.array(widths) - 1
                end[-1] -= 1
                found, crossing, _ = allocate(*tokens, begin, end, rule)
                keys += [own] * len(fields)
                names += fields
                counts.append(found)
                crossings.append(crossing)
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(names), pa.array(np.concatenate(counts)), pa.array(np.concatenate(crossings))], ["key", "field", "n_tokens", "n_crossing"])

    kind = dict(table.dtypes)[key]
    return source.mapInArrow(run, "key string, field string, n_tokens long, n_crossing long").select(F.col("key").cast(kind).alias(key), "field", "n_tokens", "n_crossing")
