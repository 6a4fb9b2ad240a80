"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared lower-cased with runs of white space as one blank. An item of ``m`` characters may occur with up to
``k = floor(rate * m)`` edits. It is cut into ``k + 1`` pieces, so any such occurrence holds one piece unchanged. An
automaton over all pieces scans each whole document once; each exact hit climbs the item's binary tree of pieces: a node
that may hold ``e`` edits has two parts that may hold ``e1 + e2 = e - 1``, so a true occurrence has a path on which every
node matches within its own budget. Nodes up to the whole item are verified with Myers' bit-parallel distance; chance
hits end at the first, short node.

Items are taken in blocks of a bounded number of characters. A block is what is sent to the workers. Blocks are worked off
one after another, each one's result being written before the next is sent, so the memory of driver and workers does not
grow with the benchmark. Nothing is shuffled and the documents' skew does not matter.

Edge cases
    Null or empty texts match nothing. Every item that is not blank takes part unless ``least_chars`` says otherwise; an
    item too short to have an edit budget must stand as whole words, so that "ion" is not found in "nation". Items with null
    id are used and reported with it; repeated items are reported each. Each row is judged by its own text, whatever ids it
    shares or lacks. Extra columns are ignored, and kept by ``keep_clean``. Empty tables give empty results.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame

from lonja.llm.store import Scratch
from lonja.llm.tables import pick

#: Characters of items in a block, the unit that is sent to workers.
BLOCK_CHARS = 250_000


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


class Node:
    """A span of an item that may hold ``budget`` edits; its bit masks are made when it is first searched for."""

    __slots__ = ("begin", "budget", "end", "item", "masks", "parent")

    def __init__(self, item: str, begin: int, end: int, budget: int, parent: Node | None):
        self.item, self.begin, self.end, self.budget, self.parent = item, begin, end, budget, parent
        self.masks: dict[str, int] = {}

    def search(self, text: str) -> tuple[int, int]:
        """Least distance to a substring of ``text``, and where that substring ends (Myers 1999)."""
        if not self.masks:
            for i, char in enumerate(self.item[self.begin : self.end]):
                self.masks[char] = self.masks.get(char, 0) | 1 << i
        size, get = self.end - self.begin, self.masks.get
        full, top = (1 << size) - 1, 1 << (size - 1)
        up, down, score, best, where = full, 0, size, size, 0
        for j, char in enumerate(text):
            same = get(char, 0)
            vertical = same | down
            horizontal = (((same & up) + up) ^ up) | same
            more, less = down | (full & ~(horizontal | up)), up & horizontal
            if more & top:
                score += 1
            elif less & top:
                score -= 1
                if score < best:
                    best, where = score, j + 1
            more, less = (more << 1) & full, (less << 1) & full
            up, down = less | (full & ~(vertical | more)), more & vertical
        return best, where


def leaves(item: str, budget: int) -> list[Node]:
    """The ``budget + 1`` pieces of an item, each linked to the larger spans that it is part of."""

    def grow(begin: int, end: int, edits: int, parent: Node | None) -> Iterator[Node]:
        node = Node(item, begin, end, edits, parent)
        if not edits:
            yield node
            return
        left = (edits - 1) // 2
        middle = begin + (end - begin) * (left + 1) // (edits + 1)
        yield from grow(begin, middle, left, node)
        yield from grow(middle, end, edits - 1 - left, node)

    return list(grow(0, len(item), budget, None))


class Matcher:
    """Finds items of one block in texts."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        import ahocorasick

        self.items = items
        pieces: dict[str, list[tuple[int, Node]]] = {}
        for number, (_, text) in enumerate(items):
            for leaf in leaves(text, int(rate * len(text))):
                pieces.setdefault(text[leaf.begin : leaf.end], []).append((number, leaf))
        self.automaton = ahocorasick.Automaton()
        for piece, owners in pieces.items():
            self.automaton.add_word(piece, (len(piece), owners))
        self.automaton.make_automaton()

    def find(self, text: str, any_item: bool = False) -> dict[int, tuple[int, int]]:
        """For each item found: least edits, and the end of that occurrence in the normalised text.

        With ``any_item`` the search ends at the first occurrence of any item.
        """
        found: dict[int, tuple[int, int]] = {}
        # Windows that have been searched whole; the leaves of one occurrence mostly share theirs.
        done: set[tuple[int, int]] = set()
        for last, (size, owners) in self.automaton.iter(text):
            for number, leaf in owners:
                origin = last + 1 - size - leaf.begin
                node, edits, end = leaf, 0, last + 1
                if number in found and not found[number][0] or (number, origin) in done:
                    continue
                if node.parent is None and not _stands_alone(text, end - size, end):
                    continue
                while node.parent is not None:
                    node = node.parent
                    low = max(0, origin + node.begin - node.budget)
                    edits, end = node.search(text[low : max(0, origin + node.end + node.budget)])
                    end += low
                    if edits > node.budget:
                        break
                else:
                    done.add((number, origin))
                    if number not in found or edits < found[number][0]:
                        found[number] = (edits, end)
                    if any_item:
                        return found
        return found


def _stands_alone(text: str, begin: int, end: int) -> bool:
    """No letter or digit goes on across either end."""
    across = [text[i - 1 : i + 1] for i in (begin, end) if 0 < i < len(text)]
    return not any(pair.isalnum() for pair in across)


_matchers: dict[str, Matcher] = {}


def _matcher(key: str, sent: Broadcast, rate: float) -> Matcher:
    """The worker's matcher of a block; that of an earlier block goes."""
    if key not in _matchers:
        _matchers.clear()
        _matchers[key] = Matcher(sent.value, rate)
    return _matchers[key]


def _blocks(items: DataFrame, least_chars: int, block_chars: int) -> Iterator[list[tuple[int | None, str]]]:
    block, size = [], 0
    for row in pick(items, "item_id", "text").where("text is not null").toLocalIterator():
        text = normalise(row["text"])
        if len(text) < max(least_chars, 1):
            continue
        if block and size + len(text) > block_chars:
            yield block
            block, size = [], 0
        block.append((row["item_id"], text))
        size += len(text)
    if block:
        yield block


def _with_last(blocks: Iterator[list[tuple[int | None, str]]]) -> Iterator[tuple[list[tuple[int | None, str]], bool]]:
    held = next(blocks, None)
    while held is not None:
        after = next(blocks, None)
        yield held, after is None
        held = after


def contaminated(docs: DataFrame, items: DataFrame, rate: float = 0.1, least_chars: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(doc_id, item_id, edits, end)`` for each document and each item of ``items(item_id, text)`` that it holds.

    ``edits`` is the least number over all its occurrences, ``end`` the end of such an occurrence in the normalised text.
    """
    schema = "doc_id long, item_id long, edits int, end long"
    spark = docs.sparkSession
    source, scratch = pick(docs, "doc_id", "text"), Scratch(spark, "contaminated")

    def scan(sent: Broadcast) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, sent, rate)
            for batch in batches:
                rows = [
                    (doc, matcher.items[number][0], *hit)
                    for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True)
                    for number, hit in matcher.find(normalise(text.as_py())).items()
                ]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "item_id", "edits", "end"])

        return source.mapInArrow(run, schema)

    found = []
    for block, last in _with_last(_blocks(items, least_chars, block_chars)):
        sent = spark.sparkContext.broadcast(block)
        found.append(scan(sent))
        if not last:
            found[-1] = scratch.write(found[-1], f"block-{len(found)}")
            sent.destroy()
    return reduce(DataFrame.union, found) if found else spark.createDataFrame([], schema)


def keep_clean(docs: DataFrame, items: DataFrame, rate: float = 0.1, least_chars: int = 0, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The rows, with all their columns, whose text holds no item."""
    spark, columns, fields = docs.sparkSession, docs.columns, docs.schema
    scratch = Scratch(spark, "clean")

    def clean(rows: DataFrame, sent: Broadcast) -> DataFrame:
        key = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = _matcher(key, sent, rate)
            for batch in batches:
                keep = [not matcher.find(normalise(text.as_py()), any_item=True) for text in batch.column("text")]
                yield batch.filter(pa.array(keep, pa.bool_())).select(columns)

        return rows.mapInArrow(run, fields)

    for number, (block, last) in enumerate(_with_last(_blocks(items, least_chars, block_chars))):
        sent = spark.sparkContext.broadcast(block)
        docs = clean(docs, sent)
        if not last:
            docs = scratch.write(docs, f"block-{number}")
            sent.destroy()
            if number:
                scratch.drop(f"block-{number - 1}")
    return docs
