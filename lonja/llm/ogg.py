"""Ogg media columns: pages with checksums, packets from lacing values, logical streams, granule timestamps (RFC 3533).

Stored form
    A payload of 8-bit samples is cut into blocks of ``BLOCK`` samples, one packet each, which two logical streams take in
    turn. Each stream begins with a header packet: magic, version, stream number, number of streams, sample rate, block
    size, samples in all, and bytes before padding. The granule position of a page is the sample of the whole payload
    after its last complete packet. Serial numbers come from the payload, so equal payloads give equal media.

Reading
    Pages are found by their capture pattern and verified by checksum; damaged ones are skipped and counted, and packets
    with a missing part are dropped. Packets are reassembled from lacing values across pages, streams separated by serial
    number, and blocks placed by their timestamps. A chained file (the same serial number begun again) starts afresh.

Edge cases
    Null text counts as empty; the payload is then padding alone. Bytes that hold no page give null features, no payload
    and zero counts. Nothing is shuffled; rows of any size are handled one at a time. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lonja.llm.tables import pick

BLOCK, RATE, STREAMS = 576, 8000, 2
MAGIC = b"lonja8b\x01"
#: magic, stream, streams, rate, block size, samples, bytes before padding
_HEADER = struct.Struct("<8sBBIIQQ")
#: capture pattern, version, flags, granule position, serial number, page number, checksum, lacing values
_PAGE = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_NO_GRANULE = -1
#: Each byte with its bits in reverse order: the checksum is the mirror image of zlib's.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
_SLICE = 256


def checksum(page: bytes) -> int:
    """CRC-32 of polynomial 0x04C11DB7, not reflected, from zero, without a final exclusive-or."""
    mirrored = zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(mirrored.to_bytes(4, "little").translate(_MIRROR), "big")


def make_page(serial: int, number: int, flags: int, granule: int, lacing: bytes, body: bytes) -> bytes:
    head = _PAGE.pack(b"OggS", 0, flags, granule, serial, number, 0, len(lacing)) + lacing
    return head[:22] + checksum(head + body).to_bytes(4, "little") + head[26:] + body


def paginate(serial: int, packets: list[tuple[bytes, int]], segments: int = 255, number: int = 0, last: bool = True) -> Iterator[tuple[int, bytes]]:
    """Pages of one stream, with the granule position each ends at; ``packets`` are (bytes, granule after it)."""
    lacing, body, granule, flags, begun = bytearray(), bytearray(), _NO_GRANULE, 0, False
    for index, (packet, after) in enumerate(packets):
        values = bytes([255]) * (len(packet) // 255) + bytes([len(packet) % 255])
        at = sent = 0
        while at < len(values):
            take = min(segments - len(lacing), len(values) - at)
            size = sum(values[at : at + take])
            lacing += values[at : at + take]
            body += packet[sent : sent + size]
            at, sent = at + take, sent + size
            done = at == len(values)
            if done:
                granule = after
            end = done and index == len(packets) - 1
            if len(lacing) == segments or end:
                yield granule, make_page(serial, number, flags | (LAST if end and last else 0), granule, bytes(lacing), bytes(body))
                number, flags = number + 1, 0 if done else CONTINUED
                lacing, body, granule = bytearray(), bytearray(), _NO_GRANULE


def pad(data: bytes) -> bytes:
    """Bytes 255 appended up to a positive multiple of the block size."""
    return data + b"\xff" * (-len(data) % BLOCK or (0 if data else BLOCK))


def write_media(data: bytes, segments: int = 255) -> bytes:
    """The media bytes of a text's bytes."""
    payload = pad(data)
    base = zlib.crc32(payload)
    pages: list[tuple[int, int, bytes]] = []
    for stream in range(STREAMS):
        serial = (base + stream) & 0xFFFFFFFF
        head = _HEADER.pack(MAGIC, stream, STREAMS, RATE, BLOCK, len(payload), len(data))
        blocks = [(payload[at : at + BLOCK], at + BLOCK) for at in range(stream * BLOCK, len(payload), STREAMS * BLOCK)]
        pages.append((-1, stream, make_page(serial, 0, FIRST | (0 if blocks else LAST), 0, bytes([len(head)]), head)))
        pages += [(granule, stream, page) for granule, page in paginate(serial, blocks, segments, 1)]
    pages.sort(key=lambda page: (page[0] != -1 or page[2][5] & FIRST == 0, page[0], page[1])) if segments == 255 else pages.sort(key=lambda page: page[2][5] & FIRST == 0)
    return b"".join(page for _, _, page in pages)


@dataclass
class Stream:
    packets: list[tuple[bytes, int | None]] = field(default_factory=list)
    partial: list[bytes] | None = None
    next_page: int | None = None


def read_streams(media: bytes) -> tuple[dict[int, Stream], int, int]:
    """Packets of each logical stream with the granule position after them (None: not stated); good and bad pages."""
    view, at, good, bad = memoryview(media), 0, 0, 0
    streams: dict[int, Stream] = {}
    while (at := media.find(b"OggS", at)) >= 0:
        if len(media) - at < _PAGE.size:
            bad += 1
            break
        _, version, flags, granule, serial, number, crc, count = _PAGE.unpack_from(media, at)
        lacing = media[at + _PAGE.size : at + _PAGE.size + count]
        start = at + _PAGE.size + count
        end = start + sum(lacing)
        if version or len(lacing) < count or end > len(media) or checksum(b"".join((view[at : at + 22], b"\0\0\0\0", view[at + 26 : end]))) != crc:
            bad, at = bad + 1, at + 4
            continue
        good, at = good + 1, end
        stream = streams.setdefault(serial, Stream())
        if flags & FIRST and stream.next_page is not None:
            stream = streams[serial] = Stream()
        if stream.next_page is not None and number != stream.next_page or not flags & CONTINUED:
            stream.partial = None
        stream.next_page = number + 1
        begun = stream.partial if flags & CONTINUED else []
        ended: list[bytes | None] = []
        size, offset = 0, start
        for value in lacing:
            size += value
            if value < 255:
                if begun is not None:
                    ended.append(b"".join([*begun, media[offset : offset + size]]) if begun else media[offset : offset + size])
                begun, offset, size = [], offset + size, 0
        stream.partial = None if count and lacing[-1] < 255 or begun is None else [*begun, media[offset : offset + size]]
        for packet in ended[:-1]:
            stream.packets.append((packet, None))
        if ended:
            stream.packets.append((ended[-1], granule if granule != _NO_GRANULE else None))
    return streams, good, bad


@dataclass
class Media:
    payload: bytes
    n_bytes: int
    streams: int
    packets: int
    seconds: float
    pages: int
    bad_pages: int
    whole: bool


def read_media(media: bytes) -> Media | None:
    """The payload put together from all streams by time, or None if no stream has a header."""
    streams, good, bad = read_streams(media)
    blocks: dict[int, bytes] = {}
    head, found, packets = None, 0, 0
    for stream in streams.values():
        if not stream.packets or len(stream.packets[0][0]) != _HEADER.size or not stream.packets[0][0].startswith(MAGIC):
            continue
        head, found = _HEADER.unpack(stream.packets[0][0]), found + 1
        step = head[2] * head[4]
        # A page states the time after its last packet; the packets before it end one step earlier each.
        after = None
        for packet, granule in reversed(stream.packets[1:]):
            after = granule if granule is not None else None if after is None else after - step
            packets += 1
            if after is not None:
                blocks[after - len(packet)] = packet
    if head is None:
        return None
    _, _, _, rate, _, samples, n_bytes = head
    payload = b"".join(blocks[at] for at in sorted(blocks))
    return Media(payload, n_bytes, found, packets, max((at + len(b) for at, b in blocks.items()), default=0) / rate, good, bad, len(payload) == samples and not bad)


def features(media: Media) -> str:
    """Duration, level and shape of the signal around its middle value, and its eight-bin histogram."""
    samples = np.frombuffer(media.payload, np.uint8)
    centred = samples.astype(np.int64) - 128
    crossings = int(np.count_nonzero((centred[1:] >= 0) != (centred[:-1] >= 0)))
    bins = np.bincount(samples >> 5, minlength=8)
    return f"seconds={media.seconds:.3f} streams={media.streams} packets={media.packets} sum={int(centred.sum())} energy={int((centred * centred).sum())} crossings={crossings} bins=" + ",".join(map(str, bins.tolist()))


def store_media(docs: DataFrame) -> DataFrame:
    """``(doc_id, media)`` for ``docs(doc_id, text)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _SLICE):
                piece = batch.slice(at, _SLICE)
                media = [write_media((x or "").encode("utf-8", "surrogatepass")) for x in piece.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return pick(docs, "doc_id", "text").mapInArrow(run, "doc_id long, media binary")


def _row(media: bytes | None) -> tuple:
    found = read_media(media) if media else None
    if found is None:
        return (None, 0, None, None, len(media or b""), hashlib.sha256(media or b"").hexdigest(), None, 0, 0, False)
    kept = found.payload
    return (found.n_bytes, len(kept), hashlib.sha256(kept).hexdigest(), zlib.crc32(kept[-32:]), len(media), hashlib.sha256(media).hexdigest(), features(found), found.pages, found.bad_pages, found.whole)


def read_media_column(stored: DataFrame) -> DataFrame:
    """Digests and features of ``stored(doc_id, media)``, all from the stored bytes."""
    kinds = {"n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "pages": pa.int32(), "bad_pages": pa.int32(), "whole": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_row(x.as_py()) for x in batch.column("media")]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *kinds])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, pages int, bad_pages int, whole boolean"
    return pick(stored, "doc_id", "media").mapInArrow(run, schema)
