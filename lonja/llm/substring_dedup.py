"""Repeated-substring removal over the de Bruijn graph of the corpus's words.

Edges are the windows of ``window`` consecutive words of each document. Sending every edge through a shuffle costs many
times the corpus, so the graph is built from compacted paths, as assemblers do:

1. Each window is owned by its minimizer, the ``seed``-word gram inside it with the smallest hash. A run of windows with
   the same minimizer occurrence is a *path*: one record (minimizer, content hash, document, start, windows) for six or
   seven edges. A window determines its minimizer, so equal windows always lie in paths with equal minimizers.
2. A join with the minimizers that occur more than once keeps the paths that can repeat at all.
3. Equal paths compact to one node whose source coordinate is the smallest (document, start). Where all paths of a
   minimizer are equal the path does not branch: every occurrence but the first repeats as a whole. Where they differ,
   the first occurrences are opened into single edges again, and edges are grouped to find which are not the first.
4. The removed spans of a document, with the source coordinates that they repeat, return to its text.

Minimizers, path contents and edges are compared by 128 bits of hash in all (64 of minimizer and 64 of content, or two
64-bit edge hashes), so distinct spans do not meet at any corpus size in reach.

Edge cases
    Null text has no words; texts shorter than a window lose nothing. Null ``doc_id`` orders before all others; rows
    without id are documents of their own, in the order in which they are read. Rows that repeat an id and text are copies
    of one document and get equal results; rows that repeat an id alone are ordered by a hash of the text. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.store import Scratch
from lonja.llm.tables import NO_ID, numbered

#: Odd multipliers of the two rolling hashes (fractional digits of the square roots of 2 and 3).
_M1, _M2 = np.uint64(0x6A09E667F3BCC909), np.uint64(0xBB67AE8584CAA73B)


def words_of(text: str | None) -> list[bytes]:
    """Runs of anything but space and U+0009 to U+000D, as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Hashes of any span of a word sequence, from running sums."""

    def __init__(self, words: list[bytes]):
        digest = xxhash.xxh3_64_intdigest
        values = np.fromiter(map(digest, words), np.uint64, len(words))
        self.sums = [self._sums(values, m) for m in (_M1, _M2)]

    @staticmethod
    def _sums(values: np.ndarray, m: np.uint64) -> tuple[np.ndarray, np.ndarray]:
        inverse = np.uint64(pow(int(m), -1, 1 << 64))
        powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(values), m)]), dtype=np.uint64)
        back = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(len(values), inverse)]), dtype=np.uint64)
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * powers[:-1], dtype=np.uint64)])
        return running, back

    def span(self, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
        running, back = self.sums[which]
        return mix((running[ends] - running[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def paths_of(rolling: Rolling, n_words: int, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer, content hash, start and number of windows of each path of a document."""
    n = n_words - window + 1
    at = np.arange(n_words - seed + 1)
    grams = rolling.span(at, at + seed)
    owner = np.lib.stride_tricks.sliding_window_view(grams, window - seed + 1).argmin(axis=1) + np.arange(n)
    starts = np.concatenate([[0], np.flatnonzero(owner[1:] != owner[:-1]) + 1])
    counts = np.diff(np.concatenate([starts, [n]]))
    offset = (owner[starts] - starts).astype(np.uint64)
    content = mix(rolling.span(starts, starts + counts + window - 1, 1) + offset)
    return grams[owner[starts]], content, starts, counts


def _paths(window: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["minimizer", "content", "doc_id", "_row", "start", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, row, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_row", "text")), strict=True):
                words = words_of(text)
                if len(words) >= window:
                    m, c, s, n = paths_of(Rolling(words), len(words), window, seed)
                    parts.append((m.view(np.int64), c.view(np.int64), np.full(len(m), doc, np.int64), np.full(len(m), row, np.int64), s.astype(np.int32), n.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)

    return run


def _edges(window: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = ["k1", "k2", "doc_id", "_row", "start"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for doc, row, text, paths in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "_row", "text", "paths")), strict=True):
                rolling = Rolling(words_of(text))
                starts = np.concatenate([np.arange(p["start"], p["start"] + p["n"]) for p in paths])
                keys = [rolling.span(starts, starts + window, i).view(np.int64) for i in (0, 1)]
                parts.append((*keys, np.full(len(starts), doc, np.int64), np.full(len(starts), row, np.int64), starts.astype(np.int32)))
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names)

    return run


def repeated_spans(docs: DataFrame, scratch: Scratch, window: int = 20, seed: int = 8) -> DataFrame:
    """``(doc_id, _row, start, n)`` of ``numbered`` documents: ``n`` windows from word ``start`` on whose word sequences also start earlier in the corpus.

    Earlier means a smaller ``doc_id``, then a smaller ``_row``, or the same document and an earlier start.
    """
    paths = docs.mapInArrow(_paths(window, seed), "minimizer long, content long, doc_id long, _row long, start int, n int")
    # Written first: a join whose sides are plain exchanges can be split where a minimizer is hot.
    again = scratch.write(paths.groupBy("minimizer").agg(F.count("*").alias("times")).where("times > 1").select("minimizer"), "again")
    found = scratch.write(paths.join(again, "minimizer"), "paths")

    firsts = found.groupBy("minimizer", "content").agg(F.min(F.struct("doc_id", "_row", "start")).alias("source"), F.first("n").alias("n"))
    firsts = scratch.write(firsts, "nodes")
    branching = firsts.groupBy("minimizer").agg(F.count("*").alias("ways")).where("ways > 1").select("minimizer")
    opened = firsts.join(branching, "minimizer", "left_semi").select("source.doc_id", "source._row", "source.start", "n")
    per_doc = opened.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("start", "n")).alias("paths"))
    edges = docs.join(per_doc, ["doc_id", "_row"]).mapInArrow(_edges(window), "k1 long, k2 long, doc_id long, _row long, start int")
    edges = scratch.write(edges, "edges")
    sources = edges.groupBy("k1", "k2").agg(F.min(F.struct("doc_id", "_row", "start")).alias("source"), F.count("*").alias("times"))
    sources = scratch.write(sources.where("times > 1").select("k1", "k2", "source"), "sources")
    later = edges.join(sources, ["k1", "k2"]).where("doc_id <> source.doc_id or _row <> source._row or start <> source.start")

    copies = found.join(firsts.select("minimizer", "content", "source"), ["minimizer", "content"]).where("doc_id <> source.doc_id or _row <> source._row or start <> source.start")
    spans = copies.select("doc_id", "_row", "start", "n").union(later.select("doc_id", "_row", "start", F.lit(1).alias("n")))
    spans = scratch.write(spans, "spans")
    scratch.drop("again", "paths", "nodes", "edges", "sources")
    return spans


def kept_words(text: str | None, spans: list[dict] | None, window: int) -> tuple[int, list[bytes]]:
    """Number of words, and the words that no span of windows covers."""
    words = words_of(text)
    if not spans:
        return len(words), words
    change = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        if span["start"] + span["n"] + window - 1 <= len(words):
            change[span["start"]] += 1
            change[span["start"] + span["n"] + window - 1] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return len(words), [words[i] for i in np.flatnonzero(keep)]


def remove_repeats(docs: DataFrame, scratch: Scratch, window: int = 20, seed: int = 8) -> DataFrame:
    """Per document ``doc_id, n_words, n_removed, kept_text``; kept words are joined by one space."""
    docs = numbered(docs, scratch)
    spans = repeated_spans(docs, scratch, window, seed)
    per_doc = spans.groupBy("doc_id", "_row").agg(F.collect_list(F.struct("start", "n")).alias("spans"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [kept_words(t, s, window) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            total = pa.array([n for n, _ in rows], pa.int64())
            gone = pa.array([n - len(kept) for n, kept in rows], pa.int64())
            kept = pa.array([b" ".join(kept).decode("utf-8", "surrogatepass") for _, kept in rows], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), total, gone, kept], ["doc_id", "n_words", "n_removed", "kept_text"])

    joined = docs.join(per_doc, ["doc_id", "_row"], "left").select(F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "text", "spans")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_text string")


def digest(kept: DataFrame) -> DataFrame:
    """``kept_text`` as its SHA-256."""
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
