"""Byte-level BPE over whole texts, each distinct piece of a group of texts being encoded once.

The pre-tokenizer always starts a new token at a space that follows a non-space character, and nothing is merged across
such a boundary. A text whose spaces all stand between non-space characters is therefore the concatenation of its
pieces (a word with the space before it), and so are its ids. The texts of a group are cut at their spaces, equal pieces
are found by a dictionary, and the distinct pieces, set one after another with a space before each, are encoded as long
texts. Every token stands for a known number of bytes, so the running sum of those tells which tokens belong to which
piece. Texts with other white space beside a space or at an end are encoded in one call each. All ids come from the
tokenizers library, the vocabulary file being a parameter. The ids of up to ``_KEPT`` short pieces are kept for the next
groups, the pieces of the last group before older ones; they take at most some 40 MB (10 on prose) at any corpus size.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts in a group: larger groups repeat more pieces and take more memory, about ten times their size.
GROUP_BYTES = 6 << 20
#: Distinct pieces that are encoded as one text, and texts whose ids are put together at once.
_JOINED, _TEXTS = 8192, 512
#: Pieces whose ids are kept from one group to the next, and the most bytes of one.
_KEPT, _KEPT_BYTES = 300_000, 24
#: White space of any kind.
_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: Pieces that the boundary rule does not cover: empty ones, and those with white space at an end.
_IRREGULAR = rf"\A\z|\A{_SPACE}|{_SPACE}\z"


def groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Begins and ends of runs of texts that hold about ``size`` bytes; a longer text is a run of its own."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    begin, before = 0, 0
    while begin < len(texts):
        end = max(begin + 1, int(np.searchsorted(upto, before + size, "right")))
        yield begin, end
        begin, before = end, int(upto[end - 1])


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs of ``values`` that begin at ``starts`` and have ``sizes``, one after another."""
    upto = np.cumsum(sizes)
    return values[np.repeat(starts - upto + sizes, sizes) + np.arange(upto[-1] if len(upto) else 0)]


class Encoder:
    """Token ids and character spans of groups of texts."""

    def __init__(self, path: str):
        # One text is encoded at a time; threads of the library would only take cores from other tasks.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        added = {i: token.content for i, token in self.tokenizer.get_added_tokens_decoder().items()}
        #: Bytes that each id stands for; a byte-level vocabulary writes each byte as one character.
        self.widths = np.zeros(max([*vocabulary.values(), *added]) + 1, np.int32)
        for token, i in vocabulary.items():
            self.widths[i] = len(token)
        for i, content in added.items():
            self.widths[i] = len(content.encode())
        self.kept, self.kept_ids, self.kept_counts = pa.array([], pa.string()), np.empty(0, np.uint32), np.empty(0, np.int64)

    def whole(self, text: str) -> np.ndarray:
        """Ids of one text, encoded in one call."""
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32) if text else np.empty(0, np.uint32)

    def _pieces(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct regular pieces with a space before each, and the number of ids of each."""
        ids, counts = [np.empty(0, np.uint32)], [np.empty(0, np.int64)]
        for at in range(0, len(pieces), _JOINED):
            some = pieces.slice(at, _JOINED)
            joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some), " ")[0].as_py()
            found = self.whole(" " + joined)
            upto = np.cumsum(self.widths[found], dtype=np.int64)
            wanted = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
            last = np.minimum(np.searchsorted(upto, wanted), len(upto) - 1)
            if not np.array_equal(upto[last], wanted):
                raise ValueError("a piece does not end where a token ends: the vocabulary is not byte-level, or merges across spaces")
            ids.append(found)
            counts.append(np.diff(np.concatenate([[-1], last])))
        return np.concatenate(ids), np.concatenate(counts)

    def _looked_up(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """As ``_pieces``; only those that are not kept are encoded, and the short ones are kept."""
        place = pc.index_in(pieces, value_set=self.kept)
        new = place.is_null()
        unknown = pieces.filter(new)
        ids, counts = self._pieces(unknown)
        ids, counts = np.concatenate([self.kept_ids, ids]), np.concatenate([self.kept_counts, counts])
        starts = np.cumsum(counts) - counts
        rows = pc.fill_null(place, 0).to_numpy().astype(np.int64)
        rows[new.to_numpy(zero_copy_only=False)] = len(self.kept) + np.arange(len(unknown))
        older = np.ones(len(counts), bool)
        older[rows] = False
        short = pc.less_equal(pc.binary_length(pieces), _KEPT_BYTES).to_numpy(zero_copy_only=False)
        keep = np.concatenate([rows[short], np.flatnonzero(older)])[:_KEPT]
        self.kept = pa.concat_arrays([self.kept, unknown]).take(pa.array(keep))
        self.kept_ids, self.kept_counts = gather(ids, starts[keep], counts[keep]), counts[keep]
        return gather(ids, starts[rows], counts[rows]), counts[rows]

    def encode(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """For runs of texts, in order: begin and end of the run, number of ids of each text, and all their ids.

        A null text has no ids.
        """
        for begin, end in groups(texts):
            for low, counts, ids in self._group(pc.fill_null(texts.slice(begin, end - begin), "")):
                yield begin + low, begin + low + len(counts), counts, ids

    def _group(self, texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        split = pc.split_pattern(texts, " ")
        coded = split.values.dictionary_encode()
        entry, pieces = coded.indices.to_numpy().copy(), coded.dictionary
        at = split.offsets.to_numpy().astype(np.int64)
        del split, coded
        bad = pc.match_substring_regex(pieces, _IRREGULAR).to_numpy(zero_copy_only=False)
        # A first piece has no space before it, so its entry is one of its own; it may be a whole text.
        firsts = pieces.take(pa.array(entry[at[:-1]])).dictionary_encode()
        irregular = np.logical_or.reduceat(bad[entry], at[:-1])
        ids, counts = self._looked_up(pieces.filter(pa.array(~bad)))
        every = np.zeros(len(pieces), np.int64)
        every[~bad] = counts
        plain = [self.whole(x) for x in firsts.dictionary.to_pylist()]
        odd = [self.whole(texts[int(i)].as_py()) for i in np.flatnonzero(irregular)]
        table = np.concatenate([ids, *plain, *odd])
        counts = np.concatenate([every, [len(x) for x in (*plain, *odd)], [0]]).astype(np.int64)
        starts = np.cumsum(counts) - counts
        entry[at[:-1]] = firsts.indices.to_numpy() + len(every)
        for number, i in enumerate(np.flatnonzero(irregular)):
            entry[at[i] : at[i + 1]] = len(counts) - 1
            entry[at[i]] = len(every) + len(plain) + number
        for low in range(0, len(texts), _TEXTS):
            bounds = at[low : low + _TEXTS + 1]
            own = entry[bounds[0] : bounds[-1]]
            sizes = counts[own]
            yield low, np.add.reduceat(sizes, bounds[:-1] - bounds[0]), gather(table, starts[own], sizes)

    def spans(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each text the begins and ends, in characters, of its tokens; a part of a character has its whole span."""
        for low, high, counts, ids in self.encode(texts):
            upto = np.cumsum(counts)
            for i, own in enumerate(np.split(ids, upto[:-1])):
                ends = np.cumsum(self.widths[own], dtype=np.int64)
                begins = ends - self.widths[own]
                data = texts[low + i].as_buffer() if len(own) else b""
                if len(own):
                    character = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, dtype=np.int64) - 1
                    begins, ends = character[begins], character[ends - 1] + 1
                yield begins, ends


_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's own; loading the vocabulary costs more than a small task; it holds that and the kept pieces."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]
