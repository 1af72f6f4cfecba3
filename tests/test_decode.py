"""Decoders against Java's image writers and readers, by the image source."""

import struct
import zlib

import numpy as np
import pytest

from docweave.operators import decode


def picture(h=61, w=83, seed=0):
    """Smooth colours, edges and a little noise."""
    y, x = np.mgrid[0:h, 0:w]
    rng = np.random.default_rng(seed)
    out = np.stack((128 + 100 * np.sin(x / 9), 128 + 90 * np.cos(y / 7), (x * 2 + y) % 256), axis=2) + rng.normal(0, 3, (h, w, 3))
    out[10:20, 15:40] = (255, 255, 255)
    out[30:34] = 0
    return np.clip(out, 0, 255).astype(np.uint8)


def written(spark, x, kind, how=None, progressive=False, quality=None):
    """A file that Java writes of an image (blue, green, red); how: its type of buffered image."""
    jvm, h, w = spark._jvm, *x.shape[:2]
    image = jvm.java.awt.image.BufferedImage(w, h, how or jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    flat = (x[..., 2].astype(int) << 16 | x[..., 1].astype(int) << 8 | x[..., 0].astype(int)).ravel() - (1 << 24)
    pixels = spark.sparkContext._gateway.new_array(jvm.int, h * w)
    for k, v in enumerate(flat.tolist()):
        pixels[k] = v
    image.setRGB(0, 0, w, h, pixels, 0, w)
    out = jvm.java.io.ByteArrayOutputStream()
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName(kind).next()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    ask = writer.getDefaultWriteParam()
    if progressive is True:
        ask.setProgressiveMode(jvm.javax.imageio.ImageWriteParam.MODE_DEFAULT)
    if quality or isinstance(progressive, str):
        ask.setCompressionMode(jvm.javax.imageio.ImageWriteParam.MODE_EXPLICIT)
        ask.setCompressionType(progressive) if isinstance(progressive, str) else ask.setCompressionQuality(quality)
    writer.write(None, jvm.javax.imageio.IIOImage(image, None, None), ask)
    stream.flush()
    return bytes(out.toByteArray())


def by_source(spark, data, folder, name):
    (folder / name).write_bytes(data)
    r = spark.read.format("image").load(str(folder / name)).select("image.*").first()
    x = np.frombuffer(bytes(r.data), np.uint8).reshape(r.height, r.width, r.nChannels)
    return np.repeat(x, 3, axis=2) if r.nChannels == 1 else x[..., :3]


@pytest.mark.parametrize(("kind", "how"), [("png", None), ("png", 2), ("png", 10), ("png", 13), ("png", 12), ("bmp", None), ("bmp", 10), ("gif", None), ("gif", 10), ("tif", None), ("tif", 10), ("tif", 12)])
def test_lossless_kinds_equal_the_image_source(spark, tmp_path, kind, how):
    x = picture()
    data = written(spark, x, kind, how)
    got = decode.decode(data)
    assert got.shape == x.shape and np.array_equal(got, by_source(spark, data, tmp_path, f"a.{kind}"))
    if how is None and kind != "gif":
        assert np.array_equal(got, x)


@pytest.mark.parametrize("packing", ["LZW", "Deflate", "PackBits", "ZLib"])
def test_packed_tiff(spark, packing):
    x = picture()
    assert np.array_equal(decode.decode(written(spark, x, "tif", progressive=packing)), x)


@pytest.mark.parametrize("size", [(61, 83), (64, 64), (8, 8), (1, 1), (3, 2), (17, 33)])
@pytest.mark.parametrize("mode", ["sequential", "progressive", "gray"])
def test_jpeg_is_near_the_image_source(spark, tmp_path, size, mode):
    data = written(spark, picture(*size), "jpg", 10 if mode == "gray" else None, mode == "progressive", 0.9)
    got, want = decode.decode(data).astype(int), by_source(spark, data, tmp_path, "a.jpg").astype(int)
    assert got.shape == want.shape and np.abs(got - want).max() <= 4 and np.abs(got - want).mean() < 0.6


def chunk(name, data):
    return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))


def filtered(x, kinds):
    """PNG with the filters given, row by row."""
    h, w, n = x.shape
    rows, before = b"", np.zeros((w, n), int)
    for row, kind in zip(x.astype(int), kinds, strict=True):
        left, corner = np.vstack((np.zeros((1, n), int), row[:-1])), np.vstack((np.zeros((1, n), int), before[:-1]))
        p = left + before - corner
        a, b, c = abs(p - left), abs(p - before), abs(p - corner)
        guess = (0 * row, left, before, (left + before) // 2, np.where((a <= b) & (a <= c), left, np.where(b <= c, before, corner)))[kind]
        rows += bytes((kind,)) + ((row - guess) & 255).astype(np.uint8).tobytes()
        before = row
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, {1: 0, 2: 4, 3: 2, 4: 6}[n], 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("channels", [1, 2, 3, 4])
def test_all_filters_mixed(channels):
    x = np.random.default_rng(channels).integers(0, 256, (23, 19, channels), dtype=np.uint8)
    for kinds in (np.arange(23) % 5, np.arange(23) % 3, np.full(23, 4), np.full(23, 3), np.zeros(23, int)):
        got = decode.decode(filtered(x, kinds.tolist()))[..., ::-1]
        assert np.array_equal(got, x[..., :3] if channels > 2 else np.repeat(x[..., :1], 3, axis=2))


@pytest.mark.parametrize("depth", [1, 2, 4, 8, 16])
def test_woven_and_shallow_png(depth):
    """Passes of interlacing, written by hand; sizes that leave passes empty."""
    for h, w in ((13, 10), (1, 1), (2, 5), (8, 8)):
        x = np.random.default_rng(depth).integers(0, 1 << min(depth, 8), (h, w))
        body = b""
        for y, c, dy, dx in ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)):
            for row in x[y::dy, c::dx]:
                if len(row):
                    bits = "".join(f"{int(v) << (8 if depth == 16 else 0):0{depth}b}" for v in row)
                    bits += "0" * (-len(bits) % 8)
                    body += b"\0" + bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8))
        data = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, 0, 0, 0, 1)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")
        assert np.array_equal(decode.decode(data)[..., 0], x * (255 // ((1 << min(depth, 8)) - 1)))


def test_damage_is_a_value_error(spark):
    x = picture()
    for kind in ("png", "bmp", "gif", "tif", "jpg"):
        data = written(spark, x, kind)
        for cut in (3, 9, 30, 60, len(data) // 2):
            try:
                assert decode.decode(data[:cut]).shape[2] == 3  # what is left of a picture
            except ValueError:
                pass
    rng = np.random.default_rng(0)
    data = bytearray(written(spark, x, "jpg"))
    for _ in range(60):
        hurt = bytearray(data)
        for k in rng.integers(20, len(data), 5):
            hurt[k] = rng.integers(0, 256)
        try:
            decode.decode(bytes(hurt))
        except ValueError:
            pass
    for data in (b"", b"no image", b"\x89PNG\r\n\x1a\n", b"\xff\xd8\xff\xd9", b"BM", b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1 << 30, 1 << 30, 8, 2, 0, 0, 0)) + chunk(b"IDAT", b"x")):
        with pytest.raises(ValueError):
            decode.decode(data)
