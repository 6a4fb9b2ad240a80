import struct
import zlib

import numpy as np
import pytest

from lonja.functions import pixels


def picture(h, w):
    y, x = np.mgrid[0:h, 0:w]
    waves = [127 + 90 * np.sin(x / 17 + k) + 35 * np.cos(y / (11 + k)) for k in range(3)]
    return np.clip(np.stack(waves, axis=2), 0, 255).astype(np.uint8)


def platform(spark, image, kind, progressive=False, grey=False):
    """The image written by the Java platform, and what that platform reads back."""
    jvm = spark.sparkContext._jvm
    h, w = image.shape[:2]
    made = jvm.java.awt.image.BufferedImage(w, h, 10 if grey else 1)
    packed = [int(r) << 16 | int(g) << 8 | int(b) for r, g, b in image.reshape(-1, 3)]
    for i, value in enumerate(packed):
        made.setRGB(i % w, i // w, value)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    settings = writer.getDefaultWriteParam()
    if progressive:
        settings.setProgressiveMode(1)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(made, None, None), settings)
    stream.close()
    content = bytes(out.toByteArray())
    back = jvm.javax.imageio.ImageIO.read(jvm.java.io.ByteArrayInputStream(content))
    read = np.array([[back.getRGB(x, y) & 0xFFFFFF for x in range(w)] for y in range(h)])
    return content, np.stack([read >> 16, read >> 8 & 255, read & 255], axis=2)


@pytest.mark.parametrize("progressive", [False, True])
@pytest.mark.parametrize("grey", [False, True])
@pytest.mark.parametrize("shape", [(37, 45), (16, 8), (1, 3)])
def test_jpeg_equals_the_platform(spark, shape, grey, progressive):
    content, expected = platform(spark, picture(*shape), "jpeg", progressive, grey)
    off = np.abs(pixels.decode(content).astype(int) - expected)
    # The platform smooths enlarged chroma; its greys come back through a linear colour space, which keeps order only.
    assert pixels.decode(content).shape == (*shape, 3)
    assert grey or off.mean() < 3 and np.median(off) <= 2


def test_jpeg_without_colour_is_exact_to_one(spark):
    plain = np.repeat(picture(40, 33)[:, :, :1], 3, axis=2)
    for progressive in (False, True):
        content, expected = platform(spark, plain, "jpeg", progressive)
        assert (b"\xff\xc2" in content) == progressive
        assert np.abs(pixels.decode(content).astype(int) - expected).max() <= 2


@pytest.mark.parametrize("kind", ["png", "bmp"])
def test_lossless_formats_equal_the_platform(spark, kind):
    image = picture(23, 31)
    content, expected = platform(spark, image, kind)
    assert (expected == image).all() and (pixels.decode(content) == image).all()


def png(h, w, depth, kind, rows, palette=b"", interlaced=0):
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, interlaced))
    return b"\x89PNG\r\n\x1a\n" + head + (chunk(b"PLTE", palette) if palette else b"") + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


def filtered(image, kinds):
    """Rows of an 8-bit image under the given filters, pixel by pixel."""
    h, w, n = image.shape
    out = bytearray()
    for y in range(h):
        out.append(kinds[y])
        for x in range(w):
            for c in range(n):
                a = int(image[y, x - 1, c]) if x else 0
                b = int(image[y - 1, x, c]) if y else 0
                d = int(image[y - 1, x - 1, c]) if x and y else 0
                p = a + b - d
                best = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                out.append((int(image[y, x, c]) - (0, a, b, (a + b) // 2, best)[kinds[y]]) % 256)
    return bytes(out)


def test_png_kinds():
    rng = np.random.default_rng(5)
    image = rng.integers(0, 256, (10, 7, 3), dtype=np.uint8)
    assert (pixels.decode(png(10, 7, 8, 2, filtered(image, [0, 1, 2, 3, 4] * 2))) == image).all()
    clear = np.concatenate([image, rng.integers(0, 256, (10, 7, 1), dtype=np.uint8)], axis=2)
    assert (pixels.decode(png(10, 7, 8, 6, filtered(clear, [4, 3, 2, 1, 0] * 2))) == image).all()
    assert pixels.decode(png(2, 9, 1, 0, b"\0\xaa\x80\0\x00\x00"))[:, :, 0].tolist() == [[255, 0, 255, 0, 255, 0, 255, 0, 255], [0] * 9]
    assert pixels.decode(png(1, 3, 2, 3, b"\0\x18", bytes(range(9)))).tolist() == [[[0, 1, 2], [3, 4, 5], [6, 7, 8]]]
    assert pixels.decode(png(1, 2, 16, 0, b"\0\x12\x34\xff\x00"))[0, :, 1].tolist() == [0x12, 0xFF]
    small = rng.integers(0, 256, (9, 6, 3), dtype=np.uint8)
    passes = [small[y::dy, x::dx] for x, y, dx, dy in pixels._PASSES]
    assert (pixels.decode(png(9, 6, 8, 2, b"".join(filtered(p, [1] * len(p)) for p in passes if p.size), interlaced=1)) == small).all()


def test_limits_and_damage(spark):
    for bad in (b"", b"no image", png(30_000, 2, 8, 2, b""), png(20_000, 20_000, 8, 2, b""), png(5, 5, 8, 2, b"\0\1"), png(2, 2, 8, 2, b"\x09" * 14), b"\xff\xd8\xff\xd9", b"BM"):
        with pytest.raises(pixels.BadImage):
            pixels.decode(bad)
    content = platform(spark, picture(20, 20), "jpeg")[0]
    for cut in range(0, len(content), 37):
        try:
            pixels.decode(content[:cut])
        except pixels.BadImage:
            pass
    assert pixels.decode_bounded(png(40, 20, 8, 2, filtered(picture(40, 20), [0] * 40)), 10).shape == (10, 5, 3)
