"""Decoding of PNG, JPEG (baseline and progressive) and BMP bytes into RGB arrays, with limits on what a file may declare.

Where Pillow is installed it decodes what is not covered here (WebP, GIF, TIFF). Sizes are read and checked before any
pixel is unpacked, so a small file that declares a huge image costs nothing. Chroma is enlarged by repetition.
"""

from __future__ import annotations

import io
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np

from lonja.functions.ocr import fit

#: Largest side and most bytes of pixels of an image.
MAX_SIDE, MAX_BYTES = 20_000, 128 * 1024 * 1024
#: Place of the k-th coefficient of a block in zigzag order: diagonals, every other one upwards.
_ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: First column and row and steps of the seven passes of an interlaced PNG.
_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


class BadImage(ValueError):
    pass


def _check(height: int, width: int, channels: int = 3) -> None:
    if not (0 < height <= MAX_SIDE and 0 < width <= MAX_SIDE) or height * width * channels > MAX_BYTES:
        raise BadImage(f"{width} x {height} pixels")


def decode(content: bytes) -> np.ndarray:
    """``height x width x 3`` bytes; ``BadImage`` if the content is no image or beyond the limits."""
    try:
        if content[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(content)
        if content[:2] == b"\xff\xd8":
            return _jpeg(content)
        if content[:2] == b"BM":
            return _bmp(content)
        return _other(content)
    except BadImage:
        raise
    except (ValueError, IndexError, KeyError, OverflowError, struct.error, zlib.error) as error:
        raise BadImage(str(error)) from error


def decode_bounded(content: bytes, longest: int | None = 1280) -> np.ndarray:
    """The image, its longest side reduced to ``longest`` at most."""
    image = decode(content)
    return image if longest is None else fit(image, longest)


def _other(content: bytes) -> np.ndarray:
    try:
        from PIL import Image
    except ImportError:
        raise BadImage("unknown format") from None
    try:
        with Image.open(io.BytesIO(content)) as image:
            _check(image.height, image.width)
            return np.asarray(image.convert("RGB"))
    except (OSError, Image.DecompressionBombError) as error:
        raise BadImage(str(error)) from error


# PNG


def _unfilter(rows: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Undoes the filters of ``h x w x unit`` rows along antidiagonals, whose pixels depend on earlier ones alone."""
    h, w, unit = rows.shape
    if kinds.size and kinds.max() > 4:
        raise BadImage("filter")
    out = np.zeros((h + 1, w + 1, unit), np.int16)
    for d in range(h + w - 1):
        y = np.arange(max(0, d - w + 1), min(h, d + 1))
        x = d - y
        left, up, corner, kind = out[y + 1, x], out[y, x + 1], out[y, x], kinds[y][:, None]
        a, b, c = np.abs(up - corner), np.abs(left - corner), np.abs(left + up - 2 * corner)
        nearest = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
        guess = np.choose(kind, [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        out[y + 1, x + 1] = (rows[y, x] + guess) & 255
    return out[1:, 1:].astype(np.uint8)


def _samples(data: bytes, at: int, height: int, width: int, channels: int, depth: int) -> tuple[np.ndarray, int]:
    """``height x width x channels`` samples that begin at ``at``, and where they end."""
    line, unit = -(-width * channels * depth // 8), max(1, channels * depth // 8)
    end = at + height * (line + 1)
    raw = np.frombuffer(data[at:end], np.uint8).reshape(height, line + 1)
    flat = _unfilter(raw[:, 1:].reshape(height, line // unit, unit), raw[:, 0].astype(np.int64)).reshape(height, line)
    if depth == 16:
        flat = flat.reshape(height, -1, 2)[:, :, 0]
    elif depth < 8:
        bits = np.unpackbits(flat, axis=1).reshape(height, -1, depth)
        flat = np.packbits(bits, axis=2)[:, :, 0] >> (8 - depth)
    return flat[:, : width * channels].reshape(height, width, channels), end


def _png(content: bytes) -> np.ndarray:
    chunks: dict[bytes, bytes] = {}
    at = 8
    while at + 8 <= len(content):
        size, name = struct.unpack_from(">I4s", content, at)
        chunks[name] = chunks.get(name, b"") + content[at + 8 : at + 8 + size] if name == b"IDAT" else content[at + 8 : at + 8 + size]
        at += size + 12
        if name == b"IEND":
            break
    width, height, depth, kind, _, _, interlaced = struct.unpack(">IIBBBBB", chunks[b"IHDR"])
    channels = _CHANNELS[kind]
    _check(height, width, max(3, channels * max(1, depth // 8)))
    most = sum(-(-height // dy) * (-(-width // dx) * channels * 2 + 9) for _, _, dx, dy in _PASSES) if interlaced else height * (width * channels * 2 + 9)
    data = zlib.decompressobj().decompress(chunks[b"IDAT"], most)
    if interlaced:
        image, begin = np.zeros((height, width, channels), np.uint8), 0
        for x, y, dx, dy in _PASSES:
            h, w = -(-(height - y) // dy), -(-(width - x) // dx)
            if h > 0 and w > 0:
                image[y::dy, x::dx], begin = _samples(data, begin, h, w, channels, depth)
    else:
        image = _samples(data, 0, height, width, channels, depth)[0]
    if kind == 3:
        return np.frombuffer(chunks[b"PLTE"], np.uint8).reshape(-1, 3)[image[:, :, 0]]
    if depth < 8:
        image = (image.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.ascontiguousarray(image[:, :, :3] if kind in (2, 6) else np.repeat(image[:, :, :1], 3, axis=2))


# BMP


def _bmp(content: bytes) -> np.ndarray:
    begin, size, width, height, _, depth, packing = struct.unpack_from("<IIiiHHI", content, 10)
    _check(abs(height), width)
    if packing not in (0, 3) or depth not in (8, 24, 32) or packing == 3 and depth != 32:
        return _other(content)
    line = (width * depth // 8 + 3) // 4 * 4
    rows = np.frombuffer(content, np.uint8, line * abs(height), begin).reshape(abs(height), line)[:, : width * depth // 8]
    if depth == 8:
        table = np.frombuffer(content[14 + size : begin], np.uint8).reshape(-1, 4)[:, 2::-1]
        image = table[rows]
    else:
        image = rows.reshape(abs(height), width, depth // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image[::-1] if height > 0 else image)


# JPEG


@dataclass
class _Part:
    """One colour component: sampling, quantiser, and coefficients of its blocks."""

    h: int
    v: int
    quantiser: int
    wide: int = 0  # blocks in a row, whole units
    high: int = 0
    own_wide: int = 0  # blocks in a row that hold pixels
    own_high: int = 0
    values: array = field(default_factory=lambda: array("h"))


@dataclass
class _Scan:
    """Bits of one restart interval, read by a window of 24 bits at each byte."""

    windows: array
    pos: int = 0
    run: int = 0  # blocks left without coefficients

    def bits(self, n: int) -> int:
        if not n:
            return 0
        value = ((self.windows[self.pos >> 3] >> (8 - (self.pos & 7))) & 0xFFFF) >> (16 - n)
        self.pos += n
        return value

    def symbol(self, table: list[int]) -> int:
        entry = table[(self.windows[self.pos >> 3] >> (8 - (self.pos & 7))) & 0xFFFF]
        if not entry:
            raise BadImage("code")
        self.pos += entry >> 8
        return entry & 255

    def signed(self, n: int) -> int:
        value = self.bits(n)
        return value if not n or value >> (n - 1) else value - (1 << n) + 1


def _scan(data: bytes) -> _Scan:
    raw = np.frombuffer(data.replace(b"\xff\x00", b"\xff") + bytes(16), np.uint8).astype(np.uint32)
    return _Scan(array("I", (raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]).tobytes()))


def _codes(counts: bytes, symbols: bytes) -> list[int]:
    """Length and symbol of the code at the front of each 16-bit window; 0 where there is none."""
    table, at, k = np.zeros(1 << 16, np.int64), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[k : k + n]:
            step = 1 << (16 - length)
            table[at : at + step] = length << 8 | symbol
            at += step
        k += n
    return table.tolist()


def _first(scan: _Scan, values: array, at: int, before: int, dc: list[int] | None, ac: list[int] | None, first: int, last: int, low: int) -> int:
    """Coefficients ``first`` to ``last`` of a block when they are sent for the first time; returns the block's mean."""
    if first == 0:
        before += scan.signed(scan.symbol(dc))
        values[at] = before << low
        first = 1
    if scan.run:
        scan.run -= 1
        return before
    while first <= last:
        code = scan.symbol(ac)
        zeros, size = code >> 4, code & 15
        if size:
            first += zeros
            values[at + _ZIGZAG[first]] = scan.signed(size) << low
            first += 1
        elif zeros == 15:
            first += 16
        else:
            scan.run = (1 << zeros) - 1 + scan.bits(zeros)
            break
    return before


def _refine(scan: _Scan, values: array, at: int, ac: list[int] | None, first: int, last: int, low: int) -> None:
    """One more bit of the coefficients ``first`` to ``last`` of a block."""
    one = 1 << low
    if first == 0:
        values[at] |= scan.bits(1) << low
        return

    def sharpen(place: int) -> None:
        if scan.bits(1) and not abs(values[place]) & one:
            values[place] += one if values[place] > 0 else -one

    while first <= last and not scan.run:
        code = scan.symbol(ac)
        zeros, size = code >> 4, code & 15
        if not size and zeros < 15:
            scan.run = (1 << zeros) + scan.bits(zeros)
            break
        new = (one if scan.bits(1) else -one) if size else 0
        while first <= last:
            place = at + _ZIGZAG[first]
            first += 1
            if values[place]:
                sharpen(place)
            elif zeros:
                zeros -= 1
            else:
                values[place] = new
                break
    if scan.run:
        for k in range(first, last + 1):
            if values[at + _ZIGZAG[k]]:
                sharpen(at + _ZIGZAG[k])
        scan.run -= 1


def _units(parts: list[_Part]) -> Iterator[list[tuple[int, int]]]:
    """Per coded unit of a scan, the (part, offset) of its blocks."""
    if len(parts) == 1:
        part = parts[0]
        for y in range(part.own_high):
            for x in range(part.own_wide):
                yield [(0, (y * part.wide + x) * 64)]
        return
    for y in range(parts[0].high // parts[0].v):
        for x in range(parts[0].wide // parts[0].h):
            yield [(i, ((y * p.v + j) * p.wide + x * p.h + k) * 64) for i, p in enumerate(parts) for j in range(p.v) for k in range(p.h)]


def _read_scan(data: bytes, parts: list[_Part], tables: list[tuple], first: int, last: int, high: int, low: int, every: int) -> None:
    """Adds a scan's bits to the coefficients. Units beyond the last restart interval keep what they have."""
    intervals = iter(re.split(rb"\xff+[\xd0-\xd7]", data) if every else [data])
    scan, before = _scan(next(intervals)), [0] * len(parts)
    for number, unit in enumerate(_units(parts)):
        if every and number and number % every == 0:
            nxt = next(intervals, None)
            if nxt is None:
                return
            scan, before = _scan(nxt), [0] * len(parts)
        for i, at in unit:
            dc, ac = tables[i]
            if high:
                _refine(scan, parts[i].values, at, ac, first, last, low)
            else:
                before[i] = _first(scan, parts[i].values, at, before[i], dc, ac, first, last, low)


def _plane(part: _Part, quantiser: np.ndarray) -> np.ndarray:
    k = np.arange(8)
    basis = np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16) * np.where(k == 0, np.sqrt(1 / 8), 0.5)[:, None]
    blocks = np.frombuffer(part.values, np.int16).reshape(-1, 64).astype(np.float32) * quantiser.astype(np.float32)
    b = basis.astype(np.float32)
    pixels = np.clip(np.rint(b.T @ blocks.reshape(-1, 8, 8) @ b + 128), 0, 255).astype(np.uint8)
    return pixels.reshape(part.high, part.wide, 8, 8).swapaxes(1, 2).reshape(part.high * 8, part.wide * 8)


def _jpeg(content: bytes) -> np.ndarray:
    quantisers: dict[int, np.ndarray] = {}
    codes: dict[tuple[int, int], list[int]] = {}
    parts: dict[int, _Part] = {}
    every, adobe, height, width, at, scans = 0, None, 0, 0, 2, 0
    while at + 4 <= len(content):
        if content[at] != 0xFF:
            raise BadImage("marker")
        marker = content[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        if marker == 0xD9:
            break
        size = struct.unpack_from(">H", content, at + 2)[0]
        body, at = content[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                table = np.zeros(64, np.int32)
                table[_ZIGZAG] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1")
                quantisers[body[0] & 15], body = table, body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                codes[body[0] >> 4, body[0] & 15], body = _codes(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker in (0xC0, 0xC1, 0xC2):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            _check(height, width)
            if depth != 8 or n not in (1, 3, 4) or parts:
                return _other(content)
            parts = {body[6 + 3 * i]: _Part(body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)}
            if any(not (1 <= p.h <= 4 and 1 <= p.v <= 4) for p in parts.values()):
                raise BadImage("sampling")
            most_h, most_v = max(p.h for p in parts.values()), max(p.v for p in parts.values())
            for p in parts.values():
                p.wide, p.high = -(-width // (8 * most_h)) * p.h, -(-height // (8 * most_v)) * p.v
                p.own_wide, p.own_high = -(-(-(-width * p.h // most_h)) // 8), -(-(-(-height * p.v // most_v)) // 8)
                p.values = array("h", bytes(128 * p.wide * p.high))
        elif 0xC3 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            return _other(content)
        elif marker == 0xDD:
            every = struct.unpack(">H", body[:2])[0]
        elif marker == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif marker == 0xDA:
            n = body[0]
            chosen = [(parts[body[1 + 2 * i]], (codes.get((0, body[2 + 2 * i] >> 4)), codes.get((1, body[2 + 2 * i] & 15)))) for i in range(n)]
            first, last, shift = body[1 + 2 * n : 4 + 2 * n]
            if last > 63 or n > 1 and first:
                raise BadImage("scan")
            end = re.compile(rb"\xff(?![\x00\xd0-\xd7\xff])").search(content, at)
            stop = end.start() if end else len(content)
            _read_scan(content[at:stop], [p for p, _ in chosen], [t for _, t in chosen], first, last, shift >> 4, shift & 15, every)
            at, scans = stop, scans + 1
    if not scans:
        raise BadImage("no scan")
    planes = []
    for p in parts.values():
        plane = _plane(p, quantisers[p.quantiser])
        rows, columns = np.arange(height) * p.v // most_v, np.arange(width) * p.h // most_h
        planes.append(plane[rows][:, columns])
    if len(planes) == 1:
        return np.repeat(planes[0][:, :, None], 3, axis=2)
    image = np.stack(planes, axis=2)
    if adobe if adobe is not None else list(parts) != [82, 71, 66] and len(planes) == 3:
        y, cb, cr = (image[:, :, i].astype(np.float32) for i in range(3))
        colours = np.stack([y + 1.402 * (cr - 128), y - 0.344136 * (cb - 128) - 0.714136 * (cr - 128), y + 1.772 * (cb - 128)], axis=2)
        image = np.concatenate([np.clip(np.rint(colours), 0, 255).astype(np.uint8), image[:, :, 3:]], axis=2)
    if len(planes) == 4:
        # What is left of white: such files of one maker hold it inverted, and their converted colours once more.
        ink = image.astype(np.uint16) if adobe is not None else 255 - image.astype(np.uint16)
        if adobe == 2:
            ink[:, :, :3] = 255 - ink[:, :, :3]
        image = (ink[:, :, :3] * ink[:, :, 3:] // 255).astype(np.uint8)
    return np.ascontiguousarray(image[:, :, :3])
