"""Language identification by rank-order profiles (Cavnar and Trenkle).

A text is lower-cased, everything but letters becomes a word break, and its n-grams of one to three letters are counted,
word breaks being part of a gram only at its ends. A language profile is the ranked list of the ``profile_size`` most
frequent grams over all training texts of that language; counts cover the whole training table. A document's own ranked
list is compared with each profile: a gram adds the difference of its two ranks, or ``profile_size`` if the profile
lacks it. The nearest profile wins, ties by code point of the language. The score is one minus the distance over the
largest possible distance.

Edge cases
    Null text, or text without letters: ``und`` with score 0. Rows with null ``lang`` never train. No training rows at
    all: every document is ``und``. Texts of any length are counted whole, in blocks. Repeated rows count as often as
    they stand in the table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lonja.llm.tables import pick

UNKNOWN = "und"
#: Code points counted at once, texts that a training task counts as one, and distinct grams that it holds before it
#: hands them on.
_BLOCK, _TEXTS, _HELD = 1 << 17, 512, 500_000
_BITS = 21


@cache
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x110000)], np.int64)


def _merge(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    found, where = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.zeros(len(found), np.int64)
    np.add.at(total, where, np.concatenate(counts))
    return found, total


def count_grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted gram codes (up to three 21-bit code points) and how often each occurs."""
    lowered = " " + text.lower() + " "
    grams, counts, before = [], [], np.empty(0, np.int64)
    for at in range(0, len(lowered), _BLOCK):
        points = _letters()[np.frombuffer(lowered[at : at + _BLOCK].encode("utf-32-le", "surrogatepass"), "<u4")]
        space = points == 32
        points = points[~space | np.concatenate([before[-1:] != 32 if len(before) else [True], ~space[:-1]])]
        # Pairs and triples that end in this block.
        two = np.concatenate([before[-1:], points])
        three = np.concatenate([before, points])
        pairs, triples = two[:-1] << _BITS | two[1:], (three[:-2] << _BITS | three[1:-1]) << _BITS | three[2:]
        found, n = np.unique(np.concatenate([points[points != 32], pairs, triples[three[1:-1] != 32]]), return_counts=True)
        grams.append(found)
        counts.append(n)
        before = three[-2:]
    return (grams[0], counts[0]) if len(grams) == 1 else _merge(grams, counts)


def _ranked(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent grams first; ties by gram code."""
    if len(grams) > size:
        floor = np.partition(counts, len(counts) - size)[len(counts) - size]
        near = counts >= floor
        grams, counts = grams[near], counts[near]
    return grams[np.argsort(-counts, kind="stable")][:size]


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, tuple[list[np.ndarray], list[np.ndarray]]] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for lang, (grams, counts) in held.items():
            found, total = _merge(grams, counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(found), pa.array(total)], ["lang", "gram", "times"])
        held.clear()

    size = 0
    for batch in (whole.slice(at, _TEXTS) for whole in batches for at in range(0, whole.num_rows, _TEXTS)):
        texts: dict[str, list[str]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text)
        for lang, own in texts.items():
            grams, counts = count_grams("\n".join(own))
            before = held.get(lang)
            merged = _merge([*before[0], grams], [*before[1], counts]) if before else (grams, counts)
            size += len(merged[0]) - (len(before[0][0]) if before else 0)
            held[lang] = ([merged[0]], [merged[1]])
        if size > _HELD:
            yield from out()
            size = 0
    yield from out()


def learn_profiles(labelled: DataFrame, profile_size: int = 400) -> dict[str, list[int]]:
    """Ranked grams of each language of ``labelled(text, lang)``: ``profile_size`` grams a language reach the driver."""
    rows = pick(labelled, "lang", "text").where("lang is not null and text is not null")
    totals = rows.mapInArrow(_train, "lang string, gram long, times long").groupBy("lang", "gram").agg(F.sum("times").alias("times"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("times"), "gram"))
    found: dict[str, list[int]] = {}
    for row in totals.withColumn("rank", rank).where(F.col("rank") <= profile_size).orderBy("lang", "rank").collect():
        found.setdefault(row["lang"], []).append(row["gram"])
    return found


class Classifier:
    def __init__(self, profiles: dict[str, list[int]], profile_size: int):
        self.langs, self.size = sorted(profiles, key=str.encode), profile_size
        self.grams = np.unique(np.array([g for own in profiles.values() for g in own], np.int64))
        self.ranks = np.full((len(self.langs), len(self.grams)), -1, np.int64)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.grams, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        grams, counts = count_grams(text) if text else (np.empty(0), np.empty(0))
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        own = _ranked(grams, counts, self.size)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        theirs = self.ranks[:, at[known]]
        apart = np.where(theirs < 0, self.size, np.abs(theirs - np.arange(len(own))[known]))
        distance = apart.sum(axis=1) + self.size * int((~known).sum())
        best = int(distance.argmin())
        return self.langs[best], 1 - float(distance[best]) / (self.size * len(own))


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile_size: int = 400) -> DataFrame:
    """``docs(doc_id, text)`` with ``lang_pred`` and ``score``; nothing but the text enters a prediction."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(profiles, profile_size)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def is_held_out() -> Column:
    """Fold 0 of 5 by the CRC-32 of the id as text; a null id is in no fold and never trains."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def identify(docs: DataFrame, profile_size: int = 400) -> DataFrame:
    """Learns on the documents that are not held out, predicts all: ``doc_id, held_out, lang_pred, score``."""
    profiles = learn_profiles(docs.where(~is_held_out() & F.col("doc_id").isNotNull()), profile_size)
    return predict(docs, profiles, profile_size).select("doc_id", is_held_out().alias("held_out"), "lang_pred", "score")


def accept(docs: DataFrame, profiles: dict[str, list[int]], least_score: float, profile_size: int = 400) -> DataFrame:
    """The rows, with all their columns, whose text has letters and resembles a profile by ``least_score`` or more."""
    columns = docs.columns
    fields = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(profiles, profile_size)
        for batch in batches:
            found = [model.predict(x.as_py()) for x in batch.column("text")]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least_score for lang, score in found], pa.bool_())).select(columns)

    return docs.mapInArrow(run, fields)
