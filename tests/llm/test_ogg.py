import hashlib
import zlib

import pytest

from lonja.llm import ogg


def crc_by_bits(data):
    crc = 0
    for byte in data:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return crc


def test_checksum_equals_the_bitwise_definition():
    for data in (b"", b"a", b"OggS" * 9, bytes(range(256))):
        assert ogg.checksum(data) == crc_by_bits(data)


@pytest.mark.parametrize("segments", [255, 7, 4, 1])
@pytest.mark.parametrize("size", [0, 1, 575, 576, 577, 5000, 60_000])
def test_round_trip_with_packets_that_span_pages(size, segments):
    data = bytes(i * 7 % 251 for i in range(size))
    found = ogg.read_media(ogg.write_media(data, segments))
    assert found.payload == ogg.pad(data) and found.n_bytes == size and found.whole and not found.bad_pages
    assert found.seconds == len(found.payload) / ogg.RATE and found.streams == 2


def test_damaged_page_is_skipped_and_counted():
    media = bytearray(ogg.write_media(bytes(5000), 12))
    media[media.rfind(b"OggS") + 40] ^= 1
    found = ogg.read_media(bytes(media))
    assert found.bad_pages == 1 and not found.whole and len(found.payload) < 5184


def test_lost_page_drops_only_packets_with_a_missing_part():
    pages = [page for _, page in ogg.paginate(9, [(bytes([i]) * 600, (i + 1) * 600) for i in range(6)], segments=4)]
    streams, good, bad = ogg.read_streams(b"junk" + b"".join(pages[:1] + pages[2:]))
    assert (good, bad) == (len(pages) - 1, 0)
    kept = [p[0] for p, _ in streams[9].packets]
    assert 0 in kept and 5 in kept and len(kept) < 6 and all(len(p) == 600 for p, _ in streams[9].packets)


def test_foreign_streams_and_rubbish():
    other = b"".join(page for _, page in ogg.paginate(77, [(b"foreign", 1)]))
    assert ogg.read_media(other) is None and ogg.read_media(b"no page at all") is None
    found = ogg.read_media(other + ogg.write_media(b"abc") + b"OggS")
    assert found.payload == ogg.pad(b"abc")


def test_column(spark, make_docs, corpus):
    docs = make_docs(corpus + [(None, "null id"), (5, dict(corpus)[5])])
    rows = ogg.read_media_column(ogg.store_media(docs)).collect()
    assert len(rows) == len(corpus) + 2
    texts = dict(corpus) | {None: "null id"}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        payload = data + b"\xff" * (-len(data) % 576 or (0 if data else 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        signs = [b >= 128 for b in payload]
        shape = f"sum={sum(b - 128 for b in payload)} energy={sum((b - 128) ** 2 for b in payload)} crossings={sum(x != y for x, y in zip(signs, signs[1:], strict=False))}"
        bins = ",".join(str(sum(b // 32 == k for b in payload)) for k in range(8))
        assert r.feature.startswith(f"seconds={len(payload) / ogg.RATE:.3f} streams=2 ") and f" {shape} bins={bins}" in r.feature
        assert r.whole and r.bad_pages == 0 and r.media_bytes > len(payload)
    same = [r for r in rows if r.doc_id in (30, 31, 32)]
    assert len({(r.media_sha256, r.feature) for r in same}) == 1


def test_empty_and_null(spark, make_docs):
    assert ogg.read_media_column(ogg.store_media(make_docs([]))).count() == 0
    broken = spark.createDataFrame([(1, None), (2, bytearray(b"rubbish"))], "doc_id long, media binary")
    assert [(r.feature, r.payload_bytes, r.whole) for r in ogg.read_media_column(broken).collect()] == [(None, 0, False)] * 2
