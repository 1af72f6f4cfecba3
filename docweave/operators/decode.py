"""Decoders of image files in numpy: PNG, BMP, GIF, TIFF and JPEG, to height x width x 3 bytes, blue, green, red.

Transparency is left out, of animations and multi-page files the first picture counts. Anything else, and damage that
leaves no picture, is a ValueError.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

#: Pixels an image may have; larger headers are damage or an attack on memory.
MOST_PIXELS = 1 << 28


def decode(data: bytes) -> np.ndarray:
    """The image of a file, by what its first bytes say."""
    kinds = {b"\x89PNG\r\n\x1a\n": png, b"BM": bmp, b"GIF8": gif, b"II*\0": tiff, b"MM\0*": tiff, b"\xff\xd8": jpeg}
    for start, kind in kinds.items():
        if data.startswith(start):
            try:
                return np.ascontiguousarray(kind(data)[..., ::-1])
            except (IndexError, struct.error, zlib.error, OverflowError, KeyError, ZeroDivisionError) as e:
                raise ValueError(f"damaged {kind.__name__} file: {e}") from e
    raise ValueError("cannot identify image file")


def _size(width: int, height: int) -> None:
    if width < 1 or height < 1 or width * height > MOST_PIXELS:
        raise ValueError(f"no image size: {width} x {height}")


def _levels(packed: np.ndarray, depth: int, width: int) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits from rows of bytes."""
    if depth == 8:
        return packed[:, :width]
    bits = np.unpackbits(packed, axis=1).reshape(len(packed), -1, depth)
    return np.packbits(bits, axis=2)[..., 0][:, :width] >> (8 - depth)


def _gray(levels: np.ndarray) -> np.ndarray:
    return np.repeat(levels.astype(np.uint8)[..., None], 3, axis=2)


def _table(colours: np.ndarray, at: np.ndarray) -> np.ndarray:
    full = np.zeros((256, 3), np.uint8)
    full[: len(colours)] = colours
    return full[at]


# ---------------------------------------------------------------- PNG


def unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Rows of bytes with PNG's filters undone; step: bytes of a pixel.

    Rows that only look up or left are done one by one. The other filters need the pixel before and above, so they go along
    diagonals: all pixels of a diagonal depend on the two diagonals before it only.
    """
    if kinds.max(initial=0) > 4:
        raise ValueError("unknown filter")
    h = len(rows)
    x = rows.reshape(h, -1, step)
    if kinds.max(initial=0) < 3:
        out = x.copy()
        for k in range(h):
            if kinds[k] == 1:
                out[k] = np.cumsum(x[k], axis=0, dtype=np.uint8)
            elif kinds[k] == 2 and k:
                out[k] += out[k - 1]
        return out.reshape(h, -1)
    w = x.shape[1]
    out = np.zeros((h + 1, w + 1, step), np.int16)
    none = np.zeros((h, step), np.int16)
    for t in range(w + h - 1):
        r = np.arange(max(0, t - w + 1), min(h, t + 1))
        c = t - r
        left, up, corner = out[r + 1, c], out[r, c + 1], out[r, c]
        p = left + up - corner
        a, b, d = np.abs(p - left), np.abs(p - up), np.abs(p - corner)
        paeth = np.where((a <= b) & (a <= d), left, np.where(b <= d, up, corner))
        guess = np.choose(kinds[r][:, None], (none[r], left, up, (left + up) >> 1, paeth))
        out[r + 1, c + 1] = (x[r, c] + guess) & 255
    return out[1:, 1:].astype(np.uint8).reshape(h, -1)


def png(data: bytes) -> np.ndarray:
    at, parts, colours, head = 8, [], np.zeros((0, 3), np.uint8), None
    while at + 8 <= len(data):
        size, name = struct.unpack_from(">I4s", data, at)
        body = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            colours = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"IDAT":
            parts.append(body)
        elif name == b"IEND":
            break
        at += 12 + size
    if head is None or not parts:
        raise ValueError("no picture in the file")
    width, height, depth, kind, _, _, woven = head
    _size(width, height)
    channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[kind]
    most = 2 * height * ((width * channels * depth + 7) // 8 + 1) + (1 << 16)  # more is not of the picture
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(parts), most), np.uint8)
    out, at = np.zeros((height, width, channels), np.uint8), 0
    # (first row, first column, row step, column step) of each pass
    passes = ((0, 0, 8, 8), (0, 4, 8, 8), (4, 0, 8, 4), (0, 2, 4, 4), (2, 0, 4, 2), (0, 1, 2, 2), (1, 0, 2, 1)) if woven else ((0, 0, 1, 1),)
    for y, x, dy, dx in passes:
        h, w = len(range(y, height, dy)), len(range(x, width, dx))
        if not h or not w:
            continue
        line = (w * channels * depth + 7) // 8
        rows = raw[at : at + h * (line + 1)].reshape(h, line + 1)
        at += h * (line + 1)
        rows = unfilter(rows[:, 0], rows[:, 1:], max(1, channels * depth // 8))
        if depth == 16:
            rows = rows[:, ::2]
        out[y::dy, x::dx] = (_levels(rows, depth, w) if depth < 8 else rows.reshape(h, -1)[:, : w * channels]).reshape(h, w, channels)
    if kind == 3:
        return _table(colours, out[..., 0])
    if channels < 3:
        return _gray(out[..., 0] * (255 // ((1 << min(depth, 8)) - 1)))
    return out[..., :3]


# ---------------------------------------------------------------- BMP, GIF, TIFF


def bmp(data: bytes) -> np.ndarray:
    start, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    if head == 12:
        width, height, _, depth = struct.unpack_from("<HHHH", data, 18)
        packing, used, each = 0, 0, 3
    else:
        width, height, _, depth, packing, _, _, _, used = struct.unpack_from("<iiHHIIiiI", data, 18)
        each = 4
    _size(width, abs(height))
    if packing not in (0, 3) or depth not in (1, 4, 8, 16, 24, 32):
        raise ValueError("packed BMP")
    line = (width * depth + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, line * abs(height), start).reshape(abs(height), line)
    rows = rows[::-1] if height > 0 else rows
    if depth <= 8:
        n = used or 1 << depth
        colours = np.frombuffer(data, np.uint8, n * each, 14 + head).reshape(n, each)[:, 2::-1]
        return _table(colours, _levels(np.ascontiguousarray(rows), depth, width))
    if depth == 24:
        return rows[:, : width * 3].reshape(-1, width, 3)[..., ::-1]
    word = np.ascontiguousarray(rows).view("<u2" if depth == 16 else "<u4")[:, :width].astype(np.uint32)
    masks = struct.unpack_from("<III", data, 54) if packing == 3 else (0x7C00, 0x3E0, 0x1F) if depth == 16 else (0xFF0000, 0xFF00, 0xFF)
    low = [m & -m for m in masks]
    return np.stack([(word & m) // s * 255 // (m // s) for m, s in zip(masks, low, strict=True)], axis=2).astype(np.uint8)


def lzw(data: bytes, first: int, most: int, gif_order: bool) -> bytes:
    """Lempel-Ziv-Welch codes with growing widths; first: bits of a sample; most: bytes wanted.

    GIF packs codes from the low bits of a byte and grows a width when a code no longer fits; TIFF packs from the high bits
    and grows one code earlier.
    """
    clear, early = 1 << first, 0 if gif_order else 1
    words: list[bytes] = []
    out, total, width, last, acc, n = [], 0, first + 1, b"", 0, 0
    for byte in data:
        acc = acc | byte << n if gif_order else (acc << 8 | byte) & 0xFFFFFFFF
        n += 8
        while n >= width:
            if gif_order:
                code, acc, n = acc & (1 << width) - 1, acc >> width, n - width
            else:
                code, n = acc >> (n - width) & (1 << width) - 1, n - width
            if code == clear:
                words, width, last = [bytes((k,)) for k in range(clear)] + [b"", b""], first + 1, b""
                continue
            if code == clear + 1 or total >= most:
                return b"".join(out)[:most]
            if not words:
                words = [bytes((k,)) for k in range(clear)] + [b"", b""]
            if code < len(words):
                word = words[code]
            elif last:
                word = last + last[:1]
            else:
                raise ValueError("wrong code")
            if last and len(words) < 4096:
                words.append(last + word[:1])
            out.append(word)
            total += len(word)
            last = word
            if len(words) + early >= 1 << width and width < 12:
                width += 1
    return b"".join(out)[:most]


def gif(data: bytes) -> np.ndarray:
    width, height, flags, ground = struct.unpack_from("<HHBB", data, 6)
    _size(width, height)
    at, colours = 13, np.zeros((0, 3), np.uint8)
    if flags & 128:
        n = 2 << (flags & 7)
        colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    while data[at] == 0x21:  # extensions
        at += 2
        while data[at]:
            at += data[at] + 1
        at += 1
    if data[at] != 0x2C:
        raise ValueError("no picture in the file")
    x, y, w, h, own = struct.unpack_from("<HHHHB", data, at + 1)
    _size(w, h)
    at += 10
    canvas = np.full((height, width), ground, np.uint8)
    if own & 128:
        n = 2 << (own & 7)
        colours = np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3)
        at += 3 * n
    first, at, parts = data[at], at + 1, []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += data[at] + 1
    found = np.zeros(w * h, np.uint8)
    got = np.frombuffer(lzw(b"".join(parts), first, w * h, True), np.uint8)
    found[: len(got)] = got
    rows = np.concatenate([np.arange(a, h, s) for a, s in ((0, 8), (4, 8), (2, 4), (1, 2))]) if own & 64 else np.arange(h)
    picture = np.empty((h, w), np.uint8)
    picture[rows] = found.reshape(h, w)
    canvas[y : y + h, x : x + w] = picture[: height - y, : width - x]
    return _table(colours, canvas)


def _packbits(data: bytes) -> bytes:
    out, at = bytearray(), 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += data[at + 1 : at + 2] * (257 - n) if n > 128 else b""
            at += 2 if n > 128 else 1
    return bytes(out)


def tiff(data: bytes) -> np.ndarray:
    order = "<" if data[:2] == b"II" else ">"
    at = struct.unpack_from(order + "I", data, 4)[0]
    tags: dict[int, list[int]] = {}
    for k in range(struct.unpack_from(order + "H", data, at)[0]):
        tag, kind, n = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
        form = {1: "B", 3: "H", 4: "I"}.get(kind)
        if form:
            where = at + 10 + 12 * k
            where = where if n * struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, where)[0]
            tags[tag] = list(struct.unpack_from(f"{order}{n}{form}", data, where))
    width, height = tags[256][0], tags[257][0]
    _size(width, height)
    depth, packing, photo = tags.get(258, [1])[0], tags.get(259, [1])[0], tags.get(262, [1])[0]
    channels, deep = tags.get(277, [1])[0], tags.get(278, [height])[0]
    if 322 in tags or tags.get(284, [1])[0] != 1 or depth not in (1, 2, 4, 8, 16) or photo not in (0, 1, 2, 3) or packing not in (1, 5, 8, 32946, 32773):
        raise ValueError("TIFF of an unusual kind")
    line, rows = (width * channels * depth + 7) // 8, []
    for k, (a, n) in enumerate(zip(tags[273], tags[279], strict=True)):
        h = min(deep, height - k * deep)
        part = data[a : a + n]
        part = {1: lambda p: p, 5: lambda p: lzw(p, 8, h * line, False), 32773: _packbits}.get(packing, zlib.decompress)(part)  # noqa: B023
        rows.append(np.frombuffer(part, np.uint8, h * line).reshape(h, line))
    x = np.concatenate(rows)
    if depth == 16:
        x = np.ascontiguousarray(x).view(order + "u2")
        x = x.reshape(height, width, channels)
        x = ((np.cumsum(x, axis=1, dtype=np.uint16) if tags.get(317, [1])[0] == 2 else x) >> 8).astype(np.uint8)
    else:
        x = _levels(x, depth, width * channels).reshape(height, width, channels)
        x = np.cumsum(x, axis=1, dtype=np.uint8) if tags.get(317, [1])[0] == 2 and depth == 8 else x
    if photo == 3:
        n = len(tags[320]) // 3
        return _table((np.array(tags[320]).reshape(3, n).T >> 8).astype(np.uint8), x[..., 0])
    if photo < 2:
        level = x[..., 0] * (255 // ((1 << min(depth, 8)) - 1))
        return _gray(255 - level if photo == 0 else level)
    return x[..., :3]


# ---------------------------------------------------------------- JPEG

#: Natural place of each coefficient in the order of the file.
ZIGZAG = np.array([
    0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28,
    35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63,
])
#: Rows are the cosines of the inverse transform of 8 values.
_COS = np.cos((2 * np.arange(8)[:, None] + 1) * np.arange(8)[None, :] * np.pi / 16) * np.where(np.arange(8) == 0, np.sqrt(1 / 8), 0.5)


class Bits:
    """Bits of an entropy-coded segment, from the high end of each byte; zeros after the end."""

    def __init__(self, data: bytes):
        self.data, self.at, self.acc, self.n = data.replace(b"\xff\x00", b"\xff"), 0, 0, 0

    def fill(self) -> None:
        part = self.data[self.at : self.at + 32]
        self.at += 32
        self.acc = (self.acc & (1 << self.n) - 1) << 256 | int.from_bytes(part.ljust(32, b"\0"))
        self.n += 256
        if self.at > len(self.data) + 4096:
            raise ValueError("damaged jpeg file: too little data")

    def read(self, many: int) -> int:
        if self.n < many:
            self.fill()
        self.n -= many
        return self.acc >> self.n & (1 << many) - 1

    def symbol(self, table: list[int]) -> int:
        """The next Huffman symbol; table: length << 8 | symbol, by the next 16 bits."""
        if self.n < 16:
            self.fill()
        found = table[self.acc >> (self.n - 16) & 0xFFFF]
        if not found:
            raise ValueError("damaged jpeg file: no such code")
        self.n -= found >> 8
        return found & 255

    def signed(self, many: int) -> int:
        v = self.read(many)
        return v if v >> (many - 1) else v - (1 << many) + 1


def huffman(counts: bytes, symbols: bytes) -> list[int]:
    table, code, at = [0] * 65536, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            a = code << (16 - length)
            table[a : a + (1 << 16 - length)] = [length << 8 | symbols[at]] * (1 << 16 - length)
            code, at = code + 1, at + 1
        code <<= 1
    return table[:65536]


class Component:
    def __init__(self, number: int, across: int, down: int, table: int):
        self.number, self.across, self.down, self.table = number, across, down, table
        self.dc = self.ac = 0

    def lay_out(self, width: int, height: int, most_x: int, most_y: int) -> None:
        """Blocks with a place in the picture, and all of them, to whole units."""
        self.wide, self.high = -(-(-(-width * self.across // most_x)) // 8), -(-(-(-height * self.down // most_y)) // 8)
        self.stride = -(-width // (8 * most_x)) * self.across
        self.blocks = np.zeros((-(-height // (8 * most_y)) * self.down * self.stride, 64), np.int32)


def jpeg(data: bytes) -> np.ndarray:
    """Sequential and progressive files of 8 bits a sample with Huffman codes; gray, YCbCr, RGB and CMYK."""
    at, quant, tables, parts, restart, adobe, frame = 2, {}, {}, [], 0, None, None
    none = [0] * 65536  # no codes
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            at += 1
            continue
        mark = data[at + 1]
        if mark in (0xFF, 0x00, 0x01) or 0xD0 <= mark <= 0xD8:
            at += 1 if mark == 0xFF else 2
            continue
        if mark == 0xD9:
            break
        size = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if mark == 0xDB:
            k = 0
            while k < len(body):
                wide, name = body[k] >> 4, body[k] & 15
                quant[name] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.int32)
                k += 1 + 64 * (1 + wide)
        elif mark == 0xC4:
            k = 0
            while k < len(body):
                counts = body[k + 1 : k + 17]
                tables[body[k]] = huffman(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif mark in (0xC0, 0xC1, 0xC2):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8 or n not in (1, 3, 4):
                raise ValueError("jpeg file of an unusual kind")
            _size(width, height)
            frame = [Component(body[6 + 3 * k], body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n)]
            most_x, most_y = max(c.across for c in frame), max(c.down for c in frame)
            for c in frame:
                c.lay_out(width, height, most_x, most_y)
            progressive = mark == 0xC2
        elif mark in (0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF):
            raise ValueError("jpeg file of an unusual kind")
        elif mark == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif mark == 0xEE and body[:5] == b"Adobe":
            adobe = body[11]
        elif mark == 0xDA:
            if frame is None:
                raise ValueError("damaged jpeg file: no frame")
            n = body[0]
            parts = []
            for k in range(n):
                c = {c.number: c for c in frame}[body[1 + 2 * k]]
                c.dc, c.ac = tables.get(body[2 + 2 * k] >> 4, none), tables.get(16 | body[2 + 2 * k] & 15, none)
                parts.append(c)
            low, high, steps = body[1 + 2 * n : 4 + 2 * n]
            at = _scan(data, at, parts, (low, high, steps >> 4, steps & 15) if progressive else None, restart, -(-width // (8 * most_x)), -(-height // (8 * most_y)))
    if frame is None or not parts:
        raise ValueError("no picture in the file")
    planes = [_plane(c, quant[c.table], width, height, most_x, most_y) for c in frame]
    if len(planes) == 1:
        return _gray(planes[0])
    x = np.stack(planes, axis=2).astype(np.float64)
    if adobe in (1, 2) or adobe is None and len(planes) == 3 and [c.number for c in frame] != [82, 71, 66]:
        y, cb, cr = x[..., 0], x[..., 1] - 128, x[..., 2] - 128
        x[..., :3] = np.clip(np.rint(np.stack((y + 1.402 * cr, y - 0.344136286 * cb - 0.714136286 * cr, y + 1.772 * cb), axis=2)), 0, 255)
    if len(planes) == 4:  # inverted, as all writers do
        x = x[..., :3] * x[..., 3:] / 255
    return np.rint(x).astype(np.uint8)


def _segments(data: bytes, at: int) -> tuple[list[bytes], int]:
    """Entropy-coded segments between restart marks, and where the next other mark is."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            return [*out, data[start:]], len(data)
        mark = data[at + 1]
        if mark == 0:
            at += 2
        elif 0xD0 <= mark <= 0xD7:
            out.append(data[start:at])
            at = start = at + 2
        elif mark == 0xFF:
            at += 1
        else:
            return [*out, data[start:at]], at


def _units(parts: list[Component], wide: int, high: int) -> Iterator[list[tuple[Component, int]]]:
    """Blocks of a scan, unit by unit: one block if the scan has one component, else all of a unit's."""
    if len(parts) == 1:
        c = parts[0]
        for y in range(c.high):
            for x in range(c.wide):
                yield [(c, y * c.stride + x)]
        return
    for y in range(high):
        for x in range(wide):
            yield [(c, (y * c.down + v) * c.stride + x * c.across + u) for c in parts for v in range(c.down) for u in range(c.across)]


def _scan(data: bytes, at: int, parts: list[Component], stage: tuple[int, int, int, int] | None, restart: int, wide: int, high: int) -> int:
    """Read one scan into the components' blocks; returns where it ends. stage: first and last coefficient, bits before and now."""
    segments, end = _segments(data, at)
    units = list(_units(parts, wide, high))
    step = restart or len(units)
    for k, segment in zip(range(0, len(units), step), segments, strict=False):
        bits, before, state = Bits(segment), {c.number: 0 for c in parts}, [0]
        for unit in units[k : k + step]:
            for c, place in unit:
                if stage is None:
                    _sequential(bits, c, c.blocks[place], before)
                elif stage[0] == 0:
                    if stage[2]:
                        c.blocks[place, 0] |= bits.read(1) << stage[3]
                    else:
                        size = bits.symbol(c.dc)
                        before[c.number] += bits.signed(size) if size else 0
                        c.blocks[place, 0] = before[c.number] << stage[3]
                elif stage[2]:
                    _refine(bits, c, c.blocks[place], stage, state)
                else:
                    _first(bits, c, c.blocks[place], stage, state)
    return end


def _sequential(bits: Bits, c: Component, block: np.ndarray, before: dict[int, int]) -> None:
    size = bits.symbol(c.dc)
    if size:
        before[c.number] += bits.signed(size)
    block[0] = before[c.number]
    k, ac, symbol, signed = 1, c.ac, bits.symbol, bits.signed
    while k < 64:
        s = symbol(ac)
        size = s & 15
        if not size:
            if s != 0xF0:
                return
            k += 16
            continue
        k += s >> 4
        block[k] = signed(size)
        k += 1


def _first(bits: Bits, c: Component, block: np.ndarray, stage: tuple[int, int, int, int], state: list[int]) -> None:
    """Higher bits of coefficients that had none; state: blocks that still are all zero."""
    if state[0]:
        state[0] -= 1
        return
    k, last, shift = stage[0], stage[1], stage[3]
    while k <= last:
        s = bits.symbol(c.ac)
        run, size = s >> 4, s & 15
        if size:
            k += run
            block[k] = bits.signed(size) << shift
            k += 1
        elif run == 15:
            k += 16
        else:
            state[0] = (1 << run) + (bits.read(run) if run else 0) - 1
            return


def _refine(bits: Bits, c: Component, block: np.ndarray, stage: tuple[int, int, int, int], state: list[int]) -> None:
    """One more bit of coefficients that have some, and new ones."""
    k, last, one = stage[0], stage[1], 1 << stage[3]

    def more(at: int) -> None:
        v = int(block[at])
        if bits.read(1) and not abs(v) & one:
            block[at] = v + one if v > 0 else v - one

    if not state[0]:
        while k <= last:
            s = bits.symbol(c.ac)
            run, size = s >> 4, s & 15
            fresh = 0
            if size:
                fresh = one if bits.read(1) else -one
            elif run < 15:
                state[0] = (1 << run) + (bits.read(run) if run else 0)
                break
            while k <= last:
                if block[k]:
                    more(k)
                elif run:
                    run -= 1
                else:
                    break
                k += 1
            if fresh and k <= last:
                block[k] = fresh
            k += 1
    if state[0]:
        for at in range(k, last + 1):
            if block[at]:
                more(at)
        state[0] -= 1


def _plane(c: Component, quant: np.ndarray, width: int, height: int, most_x: int, most_y: int) -> np.ndarray:
    """A component's samples, as large as the picture."""
    square = np.zeros((len(c.blocks), 64))
    square[:, ZIGZAG] = c.blocks * quant
    out = np.clip(np.rint(_COS @ square.reshape(-1, 8, 8) @ _COS.T + 128), 0, 255).astype(np.int32)
    rows = len(c.blocks) // c.stride
    plane = out.reshape(rows, c.stride, 8, 8).swapaxes(1, 2).reshape(rows * 8, c.stride * 8)
    plane = plane[: -(-height * c.down // most_y), : -(-width * c.across // most_x)]
    x, y = most_x // c.across, most_y // c.down
    if (x, y) == (2, 1) and plane.shape[1] > 2:
        plane = _wider(plane, 1, 2, 2)
    elif (x, y) == (2, 2) and plane.shape[1] > 2:
        # three parts of the nearer row and one of the other, then the same along the row
        up, down = np.concatenate((plane[:1], plane[:-1])), np.concatenate((plane[1:], plane[-1:]))
        tall = np.stack((3 * plane + up, 3 * plane + down), axis=1).reshape(-1, plane.shape[1])
        plane = _wider(tall, 8, 7, 4)
    else:
        plane = plane.repeat(y, axis=0).repeat(x, axis=1)
    return plane[:height, :width].astype(np.uint8)


def _wider(plane: np.ndarray, left: int, right: int, shift: int) -> np.ndarray:
    """Twice as wide: three parts of the nearer sample and one of the other, with the roundings given."""
    before, after = np.concatenate((plane[:, :1], plane[:, :-1]), axis=1), np.concatenate((plane[:, 1:], plane[:, -1:]), axis=1)
    return np.stack(((3 * plane + before + left) >> shift, (3 * plane + after + right) >> shift), axis=2).reshape(len(plane), -1)
