"""SimHash near-duplicates by tiled exact comparison.

Fingerprints
    Lower-cased (A-Z only) words are runs of anything but ASCII white space. Each shingle of ``shingle`` consecutive words,
    repeats included, is hashed with XXH64 (UTF-8, seed 42). A fingerprint bit is 1 if it is set in over half the hashes.
    Fewer words than a shingle: the whole sequence is the only shingle. No words: fingerprint zero, linked like any other.

Links
    Equal fingerprints are one node. Two fingerprints within ``radius`` bits agree on at least one of ``radius + 1`` bands
    of bits, so only fingerprints that share a band value meet. A band value's fingerprints are cut into slices of at most
    about ``slice_rows``, and each pair of slices is a cell of its own, so a hot value becomes many cells of bounded size.
    In a cell the fingerprints stand in order of population count and are compared tile by tile with exclusive-or and bit
    counts; tile pairs whose population counts differ beyond the radius are skipped. A cell hands on a spanning forest of
    its links, never all pairs. Components come from distributed star contraction.

Similar texts
    ``similar_groups`` serves filtering stages, which need a stated similarity: a link is a Jaccard similarity of at least 0.8
    of the texts' sets of five-word shingles, computed on the sets. Everything before that only chooses whom to compare.
    Equal sets are one node. ``BANDS`` groups of ``ROWS`` min-hashes deal nodes to cells; a pair at 0.8 shares no cell with a
    probability of 3e-6. In a cell, pairs go on whose set sizes allow the similarity and whose ``SKETCH``-bit SimHashes differ
    in no more bits than the mean of a pair at 0.8 plus four standard deviations. A first round compares each row's nearest
    row and the cell's best connected one. The second compares every pair that the first has not already put in one
    component, in the first cell that the two share: the rows that stand in such a pair are sent there with their sets, and
    spanning links come back, so no pairs of a large group are written.

Edge cases
    Null text has no words. Null ``doc_id``: the row takes part, its component is named by the smallest non-null ``doc_id``
    reachable, null if there is none. Repeated rows give repeated results, but ``keep_one`` keeps one row of each group,
    whatever ids its rows share or lack. Texts of any length are compared whole. Empty tables give empty results. Extra
    columns are ignored, and kept by ``keep_one``.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lonja.llm.components import components
from lonja.llm.store import Scratch
from lonja.llm.substring_dedup import Rolling, mix
from lonja.llm.tables import pick

SEED = 42
#: Hashes whose bits are counted at once.
_BLOCK = 1 << 16
#: Side of a comparison tile.
_TILE = 512
#: Bits of the sketch that chooses the pairs of similar texts to compare.
SKETCH = 512
#: Min-hash groups of similar texts, and min-hashes in each.
BANDS, ROWS = 24, 4
#: Texts that are held at once as sets of shingles.
_ROWS = 512
#: Shingles of a slice of a hot cell.
_SLICE_GRAMS = 2_000_000
#: Columns of bytes that hold arrays of numbers.
_PACKED = {"sketch": np.uint64, "marks": np.uint32}


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The 64-bit fingerprint of a text, unsigned."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return digest(joined, SEED)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones, total = np.zeros(64, np.int64), len(starts)
    for at in range(0, total, _BLOCK):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + _BLOCK], ends[at : at + _BLOCK], strict=True)], "<u8")
        ones += _bit_counts(hashes[:, None])
    return int.from_bytes(np.packbits(ones * 2 > total, bitorder="little").tobytes(), "little")


def _bit_counts(words: np.ndarray) -> np.ndarray:
    """How many rows have each bit set; runs of 255 rows are added without leaving bytes."""
    bits = np.unpackbits(np.ascontiguousarray(words).view(np.uint8), axis=1, bitorder="little")
    ones = np.zeros(bits.shape[1], np.int64)
    for at in range(0, len(bits), 255):
        ones += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return ones


def grams(text: str | None, shingle: int = 5) -> np.ndarray:
    """The set of a text's shingles as sorted hashes; empty if there are no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    starts = np.arange(max(1, len(words) - shingle + 1))
    return np.unique(Rolling(words).span(starts, np.minimum(starts + shingle, len(words))))


def sketch(text: str | None, shingle: int = 5) -> bytes:
    """The long SimHash of the set of a text's shingles; all zero if there are no words."""
    return _sketch(grams(text, shingle))


def _sketch(hashes: np.ndarray) -> bytes:
    ones = np.zeros(SKETCH, np.int64)
    steps = (np.arange(SKETCH // 64, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), _BLOCK // 8):
        ones += _bit_counts(mix(hashes[at : at + _BLOCK // 8, None] + steps))
    return np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes()


def sketch_limit(similarity: float, deviations: float = 0) -> int:
    """Expected differing bits of two equally large sets of that Jaccard similarity, plus so many standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return round(SKETCH * share + deviations * math.sqrt(SKETCH * share * (1 - share)))


_TURNS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)


def min_hashes(hashes: np.ndarray) -> np.ndarray:
    """One 64-bit value for each band; sets share each with the probability of their similarity to the power of ``ROWS``."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[at : at + 1024, None] * _TURNS).min(axis=0), out=least)
    value = np.arange(BANDS, dtype=np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        value = mix(value * np.uint64(0x9E3779B97F4A7C15) + row)
    return value


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``(doc_id, fp)``; ``fp`` holds the 64 bits as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(x, shingle) for x in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints.view(np.int64))], ["doc_id", "fp"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _close(left: np.ndarray, right: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within the radius; both sides in order of population count."""
    ranks_l, ranks_r = np.bitwise_count(left), np.bitwise_count(right)
    ranks_l, ranks_r = ranks_l.astype(np.int64), ranks_r.astype(np.int64)
    for a in range(0, len(left), _TILE):
        tile = left[a : a + _TILE]
        low = np.searchsorted(ranks_r, ranks_l[a] - radius, "left")
        high = np.searchsorted(ranks_r, ranks_l[a + len(tile) - 1] + radius, "right")
        for b in range(low, high, _TILE):
            other = right[b : min(b + _TILE, high)]
            i, j = np.nonzero(np.bitwise_count(tile[:, None] ^ other[None, :]) <= radius)
            yield i + a, j + b


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges with the same components, fewer than ``n`` of them."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        after = label.copy()
        np.minimum.at(after, a, low)
        np.minimum.at(after, b, low)
        after = after[after]
        if np.array_equal(after, label):
            moved = np.flatnonzero(label != np.arange(n))
            return moved, label[moved]
        label = after


def cell_links(side: np.ndarray, prints: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs that link a cell: within its rows if there is one side, else between the two sides."""
    order = np.argsort(np.bitwise_count(prints), kind="stable")
    side, prints = side[order], prints[order]
    low = side == side.min()
    left = np.flatnonzero(low)
    right = left if low.all() else np.flatnonzero(~low)
    found = []
    for i, j in _close(prints[left], prints[right], radius):
        a, b = left[i], right[j]
        apart = a < b if low.all() else slice(None)
        a, b = a[apart], b[apart]
        found.append((a, b))
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    if len(a) > len(prints):
        a, b = _forest(len(prints), a, b)
    return order[a], order[b]


def _by_cell(columns: tuple[str, ...], solve: Callable[..., tuple[np.ndarray, ...]], rows: bool = False) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Applies ``solve(side, *columns)`` to the rows of each cell, which stand together.

    It returns pairs of row numbers, which become pairs of nodes ``u, v``; with ``rows`` the numbers of rows to hand on.
    """

    def read(batch: pa.RecordBatch, name: str) -> np.ndarray:
        column = batch.column(name)
        if name in _PACKED:
            return np.frombuffer(b"".join(column.to_pylist()), _PACKED[name]).reshape(batch.num_rows, -1)
        if name == "grams":
            found = np.empty(batch.num_rows, object)
            found[:] = [np.frombuffer(x.as_buffer(), np.uint64) for x in column]
            return found
        return column.to_numpy()

    def pairs(side: np.ndarray, node: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
        i, j = solve(side, *rest)
        return node[i], node[j]

    def cells(key: np.ndarray, batch: pa.Table, side: np.ndarray, node: np.ndarray, *rest: np.ndarray) -> Iterator[pa.RecordBatch]:
        bounds = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1).tolist(), len(key)]
        spans = [(a, b) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 1]
        if rows:
            found = [a + solve(side[a:b], *(x[a:b] for x in rest))[0] for a, b in spans]
            yield from batch.take(pa.array(np.concatenate([np.empty(0, np.int64), *found]))).combine_chunks().to_batches()
            return
        found = [pairs(side[a:b], node[a:b], *(x[a:b] for x in rest)) for a, b in spans]
        u, v = (np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*found, strict=True) if found else ((), ())))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left, rest = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.column_stack([batch.column(c).to_numpy() for c in ("key", "i", "j")])
            now, whole = (key, *(read(batch, c) for c in ("side", "node", *columns))), pa.Table.from_batches([batch] if rows else [], batch.schema)
            if rest is not None:
                now, whole = tuple(np.concatenate(x) for x in zip(rest, now, strict=True)), pa.concat_tables([left, whole])
            last = int(np.flatnonzero((now[0] != now[0][-1]).any(axis=1))[-1]) + 1 if (now[0][0] != now[0][-1]).any() else 0
            if last:
                yield from cells(now[0][:last], whole.slice(0, last), *(x[:last] for x in now[1:]))
            left, rest = whole.slice(last), tuple(x[last:] for x in now)
        if rest is not None:
            yield from cells(rest[0], left, *rest[1:])

    return run


def _repeated(banded: DataFrame, slice_rows: int, slice_grams: int | None = None) -> DataFrame:
    """Rows ``(key, node)`` whose key repeats, with the number of slices of their key.

    Slices hold about ``slice_rows`` rows; with ``slice_grams`` also no more than about so many shingles by ``size``.
    """
    parts = F.col("n") / slice_rows
    if slice_grams:
        parts = F.greatest(parts, F.col("grams") / slice_grams)
    sizes = banded.groupBy("key").agg(F.count("*").alias("n"), (F.sum("size") if slice_grams else F.lit(0)).alias("grams"))
    return banded.join(sizes.where("n > 1").select("key", F.ceil(parts).cast("int").alias("slices")), "key")


def _cells(sized: DataFrame, *carried: str) -> DataFrame:
    """The rows of ``sized(key, node, slices)`` once for each cell of their slice, cells standing together."""
    sliced = sized.withColumn("side", F.pmod(F.xxhash64("node", F.lit(1)), F.col("slices")).cast("int"))
    cells = sliced.select("key", "node", *carried, "side", F.explode(F.expr("sequence(0, slices - 1)")).alias("other")).select(
        "key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "side", "node", *carried
    )
    return cells.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")


def links(nodes: DataFrame, radius: int = 3, slice_rows: int = 2048) -> DataFrame:
    """Spanning links ``(u, v)`` between the rows of ``nodes(node, fp)`` within ``radius`` bits.

    Every component of the full link graph is connected by the returned links.
    """
    bands = radius + 1
    width = 64 // bands
    # The last band takes the bits that are left, so only the others need a mask.
    values = [F.shiftrightunsigned("fp", i * width).bitwiseAND(F.lit((1 << width) - 1 if i < bands - 1 else -1)) for i in range(bands)]
    banded = nodes.select("node", "fp", F.posexplode(F.array(*values)).alias("band", "value")).select("node", "fp", F.xxhash64("band", "value").alias("key"))
    solve = lambda side, prints: cell_links(side, prints.view(np.uint64), radius)
    return _cells(_repeated(banded, slice_rows), "fp").mapInArrow(_by_cell(("fp",), solve), "u long, v long")


def near_duplicates(docs: DataFrame, scratch: Scratch, shingle: int = 3, radius: int = 3) -> DataFrame:
    """One row per input row: ``doc_id, fingerprint`` (16 hexadecimal digits), ``component_id``."""
    prints = scratch.write(fingerprints(docs, shingle), "prints")
    nodes = scratch.write(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    roots = components(links(nodes.select(F.col("fp").alias("node"), "fp"), radius), scratch)
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _allowed(side: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, groups: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Tile by tile: rows of one side, rows of the other, and the distance of each pair.

    It is beyond ``SKETCH`` for pairs of one group and where sizes or sketches do not allow the similarity.
    """
    low = side == side.min()
    left = np.flatnonzero(low)
    right = left if low.all() else np.flatnonzero(~low)
    rows = max(1, _TILE * _TILE // len(right))
    for at in range(0, len(left), rows):
        tile = left[at : at + rows]
        distance = np.zeros((len(tile), len(right)), np.int64)
        for word in range(sketches.shape[1]):
            distance += np.bitwise_count(sketches[tile, word][:, None] ^ sketches[right, word][None, :])
        small, large = np.minimum(sizes[tile][:, None], sizes[right][None, :]), np.maximum(sizes[tile][:, None], sizes[right][None, :])
        barred = (distance > sketch_limit(similarity, 4)) | (small < similarity * large - 1e-6) | (groups[tile][:, None] == groups[right][None, :])
        distance[barred] = SKETCH + 1
        yield tile, right, distance


def sure_pairs(side: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, groups: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """At most two pairs for each row of a cell: with its nearest row, and with the row that has the most near rows."""
    limit, near = sketch_limit(similarity, 4), sketch_limit(similarity)
    degrees, found = np.zeros(len(side), np.int64), [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for tile, right, distance in _allowed(side, sketches, sizes, groups, similarity):
        close = distance <= near
        degrees[tile] += close.sum(axis=1)
        if side[tile[0]] != side[right[0]]:
            degrees[right] += close.sum(axis=0)
        nearest = distance.argmin(axis=1)
        some = distance[np.arange(len(tile)), nearest] <= limit
        found.append((tile[some], right[nearest[some]]))
    if degrees.any():
        hub = int(degrees.argmax())
        others = np.flatnonzero(side != side[hub]) if side.min() != side.max() else np.arange(len(side))
        distance = np.bitwise_count(sketches[others] ^ sketches[hub]).sum(axis=1, dtype=np.int64)
        others = others[(distance <= near) & (groups[others] != groups[hub])]
        found.append((np.full(len(others), hub), others))
    a, b = (np.concatenate(x) for x in zip(*found, strict=True))
    return a, b


def _pairs_of_this_cell(side: np.ndarray, key: np.ndarray, sketches: np.ndarray, sizes: np.ndarray, groups: np.ndarray, marks: np.ndarray, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Allowed pairs whose first common min-hash group is the cell's own, so that each pair is compared in one cell only."""
    own = int(np.flatnonzero(marks[0] == np.uint32(int(key[0]) & 0xFFFFFFFF))[0])
    for tile, right, distance in _allowed(side, sketches, sizes, groups, similarity):
        i, j = np.nonzero(distance <= SKETCH)
        a, b = tile[i], right[j]
        here = a < b if side[tile[0]] == side[right[0]] else np.ones(len(a), bool)
        here[here] = (marks[a[here]] == marks[b[here]]).argmax(axis=1) == own
        yield a[here], b[here]


def rows_to_compare(side: np.ndarray, *columns: np.ndarray, similarity: float) -> tuple[np.ndarray]:
    """Rows of a cell that stand in a pair to compare."""
    wanted = np.zeros(len(side), bool)
    for a, b in _pairs_of_this_cell(side, *columns, similarity):
        wanted[a] = wanted[b] = True
    return (np.flatnonzero(wanted),)


def jaccard_at_least(one: np.ndarray, two: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets of hashes have that similarity."""
    merged = np.concatenate([one, two])
    merged.sort(kind="stable")
    both = int((merged[1:] == merged[:-1]).sum())
    return both >= similarity * (len(merged) - both) - 1e-6


def cell_similar(side: np.ndarray, grams: np.ndarray, *columns: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of a cell: pairs of rows of that similarity; pairs that earlier links connect are not compared."""
    parent = list(range(len(side)))

    def root(n: int) -> int:
        while parent[n] != n:
            parent[n] = n = parent[parent[n]]
        return n

    found = []
    for a, b in _pairs_of_this_cell(side, *columns, similarity):
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            one, two = root(i), root(j)
            if one != two and jaccard_at_least(grams[i], grams[j], similarity):
                parent[one] = two
                found.append((i, j))
    i, j = np.array(found, np.int64).reshape(-1, 2).T
    return i, j


def similar_links(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs(u, v)`` whose sets of ``sets(node, grams)`` have that Jaccard similarity at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = zip(*([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in ("one", "two")), strict=True)
            keep = [jaccard_at_least(one, two, similarity) for one, two in sets]
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    one, two = (sets.select(F.col("node").alias(n), F.col("grams").alias(g)) for n, g in (("u", "one"), ("v", "two")))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "one", "two").mapInArrow(run, "u long, v long")


def similar_groups(docs: DataFrame, scratch: Scratch, similarity: float = 0.8, shingle: int = 5, slice_rows: int = 2048) -> DataFrame:
    """One row per input row: ``doc_id, component_id``, the smallest id of the texts that reach it by similarity.

    Texts without words are one group.
    """
    prints, placed = _similar_classes(docs, scratch, similarity, shingle, slice_rows)
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = placed.join(named, "root").select("node", "component_id")
    return prints.select("doc_id", "node").join(classes, "node").select("doc_id", "component_id")


def _similar_classes(docs: DataFrame, scratch: Scratch, similarity: float, shingle: int, slice_rows: int) -> tuple[DataFrame, DataFrame]:
    """``(doc_id, key, node)`` of each row, ``key`` being a hash of its text, and ``(node, least, root)`` of each node."""

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            sets = [grams(x, shingle) for x in batch.column("text").to_pylist()]
            nodes = np.fromiter((xxhash.xxh3_64_intdigest(x.tobytes()) for x in sets), np.uint64, len(sets)).view(np.int64)
            found = {"doc_id": batch.column("doc_id"), "key": batch.column("key"), "node": pa.array(nodes), "size": pa.array([len(x) for x in sets], pa.int64())}
            bands = [min_hashes(x) for x in sets]
            found |= {"sketch": pa.array(map(_sketch, sets), pa.binary()), "marks": pa.array([x.astype(np.uint32).tobytes() for x in bands], pa.binary())}
            found["bands"] = pa.array([x.view(np.int64) for x in bands], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(list(found.values()), list(found))

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (whole.slice(at, _ROWS) for whole in batches for at in range(0, whole.num_rows, _ROWS)):
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([grams(x, shingle).tobytes() for x in batch.column("text").to_pylist()], pa.binary())], ["node", "grams"])

    keyed = pick(docs, "doc_id", "text").withColumn("key", F.expr("xxhash64(text)"))
    prints = scratch.write(keyed.mapInArrow(prepare, "doc_id long, key long, node long, size long, sketch binary, marks binary, bands array<long>"), "prints")
    firsts = [F.first(c).alias(c) for c in ("key", "size", "sketch", "marks", "bands")]
    nodes = scratch.write(prints.groupBy("node").agg(F.min("doc_id").alias("least"), *firsts), "nodes")

    met = scratch.write(_repeated(nodes.select("node", "size", F.explode("bands").alias("key")), slice_rows, _SLICE_GRAMS).drop("size"), "met")
    wanted = scratch.write(nodes.join(met.select("node").distinct(), "node", "left_semi").select("node", "key", "size", "sketch", "marks"), "wanted")
    texts = keyed.select("key", "text").join(wanted.select("key", "node"), "key").dropDuplicates(["node"])
    sets = scratch.write(texts.mapInArrow(spell, "node long, grams binary"), "sets")

    def mixed(groups: DataFrame, *columns: str) -> DataFrame:
        """Rows of the cells that hold several groups of ``groups(node, group)``."""
        rows = met.join(groups, "node")
        several = rows.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
        return _cells(rows.join(several, "key", "left_semi").join(wanted.select("node", *columns), "node"), *columns, "group")

    nearest = lambda side, sketches, sizes, group: sure_pairs(side, sketches, sizes, group, similarity)
    pairs = mixed(wanted.select("node", F.col("node").alias("group")), "sketch", "size").mapInArrow(_by_cell(("sketch", "size", "group"), nearest), "u long, v long")
    pairs = scratch.write(pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    sure = scratch.write(similar_links(pairs, sets, similarity), "sure")
    joined = components(sure, scratch, "first")

    # What is left may be many pairs of few rows, so rows are handed on, and pairs never leave their cell.
    cells = mixed(wanted.select("node").join(joined, "node", "left").select("node", F.coalesce("root", "node").alias("group")), "sketch", "size", "marks")
    columns = ("key", "sketch", "size", "group", "marks")
    marked = scratch.write(cells.mapInArrow(_by_cell(columns, partial(rows_to_compare, similarity=similarity), rows=True), cells.schema), "marked")
    spelled = marked.join(sets, "node").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    rest = spelled.mapInArrow(_by_cell(("grams", *columns), partial(cell_similar, similarity=similarity)), "u long, v long")
    roots = components(sure.union(scratch.write(rest, "rest")), scratch)
    scratch.drop("met", "wanted", "sets", "pairs", "marked")
    placed = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    return prints.select("doc_id", "key", "node"), placed


def keep_one(docs: DataFrame, scratch: Scratch, similarity: float = 0.8, shingle: int = 5, slice_rows: int = 2048) -> DataFrame:
    """One row, with all its columns, of each group of similar texts: that of the smallest ``doc_id``, nulls last.

    Of several texts with that id the one of the smallest hash stays, of several rows with that id and text any one.
    """
    prints, placed = _similar_classes(docs, scratch, similarity, shingle, slice_rows)
    rows = prints.join(placed.select("node", "root"), "node").groupBy("root", "doc_id", "key").agg(F.count("*").alias("rows"))
    chosen = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "key", "rows")).alias("it"))
    chosen = scratch.write(chosen.select(F.col("it.doc_id").alias("_id"), F.col("it.key").alias("_key"), F.col("it.rows").alias("_rows")), "chosen")
    same = (F.col("doc_id").eqNullSafe(F.col("_id"))) & (F.expr("xxhash64(text)") == F.col("_key"))
    kept = docs.join(chosen.where("_rows = 1"), same, "left_semi")
    several = chosen.where("_rows > 1")
    if several.isEmpty():
        return kept
    again = docs.join(several, same, "left_semi").withColumn("_key", F.expr("xxhash64(text)")).dropDuplicates(["doc_id", "_key"])
    return kept.union(again.drop("_key"))
