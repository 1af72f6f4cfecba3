"""MPEG audio in a binary column: frames, tags, variable-bitrate tables, checksums, durations and seek offsets."""

from __future__ import annotations

import functools
import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows

# Fixed values of the MPEG audio header, by version and layer.
KBPS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

#: A payload is padded with this byte to a positive multiple of BLOCK.
PAD, BLOCK = 255, 576


@dataclass(frozen=True)
class Header:
    version: int  # 1, 2; 2.5 counts as 2 with lower rates
    layer: int
    protected: bool
    kbps: int
    rate: int
    length: int
    samples: int
    mono: bool

    @property
    def side(self) -> int:
        """Bytes of side information of a layer III frame."""
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)


@functools.lru_cache(maxsize=4096)
def header(word: bytes) -> Header | None:
    """The frame header in 4 bytes; None if they are none (free-format frames have no length and count as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    v, layer, b, r = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3), word[2] >> 4, word[2] >> 2 & 3
    if v == 1 or layer == 4 or b in (0, 15) or r == 3:
        return None
    version = 1 if v == 3 else 2
    kbps, rate, pad = KBPS[version, layer][b], RATES[v][r], word[2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    length = (12000 * kbps // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // rate + pad
    return Header(version, layer, not word[1] & 1, kbps, rate, length, samples, word[3] >> 6 == 3)


def _crc_table() -> list[int]:
    out = []
    for k in range(256):
        c = k << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


CRC = _crc_table()


@functools.lru_cache(maxsize=65536)
def crc16(data: bytes) -> int:
    """CRC-16 of MPEG audio: polynomial 0x8005, begins with all ones."""
    c = 0xFFFF
    for x in data:
        c = (c << 8 & 0xFFFF) ^ CRC[c >> 8 ^ x]
    return c


@functools.lru_cache(maxsize=65536)
def crc16_bits(data: bytes, n: int) -> int:
    """CRC-16 of the first n bits."""
    c = crc16(data[: n // 8])
    for k in range(n % 8):
        top = c >> 15 ^ data[n // 8] >> 7 - k & 1
        c = c << 1 & 0xFFFF
        if top:
            c ^= 0x8005
    return c


# Fixed values of layer II: bits of the allocation field by subband, for each table of the standard.
_ALLOCATION = {
    "a": (4,) * 11 + (3,) * 12 + (2,) * 4,
    "b": (4,) * 11 + (3,) * 12 + (2,) * 7,
    "c": (4,) * 2 + (3,) * 6,
    "d": (4,) * 2 + (3,) * 10,
    "lsf": (4,) * 4 + (3,) * 7 + (2,) * 19,
}


def checked_bits(frame: bytes, h: Header) -> tuple[bytes, int] | None:
    """What the checksum of a frame covers: the last 2 header bytes and then so many bits of the frame; None if it is cut.

    Layer III: side information. Layer I: bit allocation. Layer II: bit allocation and scale-factor selection.
    """
    body = frame[6:]
    if h.layer == 3:
        n = 8 * h.side
    else:
        mode, bound = frame[3] >> 6, 4 * ((frame[3] >> 4 & 3) + 1)
        channels = 1 if mode == 3 else 2
        width = (4,) * 32
        if h.layer == 2:
            per = h.kbps // channels
            table = "lsf" if h.version == 2 else (
                ("d" if h.rate == 32000 else "c") if per <= 48 else "a" if per <= 80 or h.rate == 48000 else "b"
            )
            width = _ALLOCATION[table]
        shared = len(width) if mode != 1 else min(bound, len(width))  # from here on both channels have one allocation
        fields = [w for k, w in enumerate(width) for _ in range(channels if k < shared else 1)]
        n = sum(fields)
        if h.layer == 2:
            if 8 * len(body) < n:
                return None
            bits, at = int.from_bytes(body[: (n + 7) // 8]) >> -n % 8, n
            for k, w in enumerate(width):
                for _ in range(channels if k < shared else 1):
                    at -= w
                    if bits >> at & (1 << w) - 1:  # a band that is there has 2 bits of selection in each channel
                        n += 2 * (1 if k < shared else channels)
    return (frame[2:4] + body[: (n + 7) // 8], 16 + n) if 8 * len(body) >= n else None


@dataclass
class Media:
    """What :func:`parse` finds. offsets: byte offset of every audio frame (seek table); duration: exact seconds."""

    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    duration: Fraction = Fraction(0)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict | None = None
    crc_good: int = 0
    crc_bad: int = 0
    crc_unchecked: int = 0
    skipped: int = 0
    resyncs: int = 0
    kbps: dict[int, int] = field(default_factory=dict)
    rate: int = 0


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _text_frame(name: str, body: bytes, tags: dict[str, str]) -> None:
    if name[0] == "T" and body:
        text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
        key, _, value = text.partition("\0") if name in ("TXXX", "TXX") else (name, "", text)
        tags[key] = value


def _frame_body(major: int, flags: int, body: bytes, apart: bool) -> bytes:
    """What a frame holds, without what its flags put before it; nothing if it is encrypted or its packing is damaged.

    apart: zeros stand after bytes 255, so that nothing looks like a frame header of audio (unsynchronisation).
    """
    if major == 3:  # the whole tag was put together again before
        packed, locked, group, length = flags & 0x80, flags & 0x40, flags & 0x20, 4 if flags & 0x80 else 0
        body = body[length + bool(group) :]
    else:
        packed, locked, group, length = flags & 0x08, flags & 0x04, flags & 0x40, 4 if flags & 0x01 else 0
        body = body[bool(group) + length :]
        body = body.replace(b"\xff\0", b"\xff") if apart or flags & 0x02 else body
    if locked:
        return b""
    try:
        return zlib.decompressobj().decompress(body, 1 << 20) if packed else body
    except zlib.error:
        return b""


def _id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Read the tag at the start, if any, into ``tags``; returns where audio may begin. Extended headers are skipped."""
    if data[:3] != b"ID3" or len(data) < 10 or any(x & 0x80 for x in data[6:10]):
        return 0
    end, major, apart, extended = 10 + _synchsafe(data[6:10]), data[3], bool(data[5] & 0x80), bool(data[5] & 0x40)
    tag, at = data[10:end], 0
    if apart and major < 4:
        tag = tag.replace(b"\xff\0", b"\xff")
    if extended and major == 3:
        at = 4 + int.from_bytes(tag[:4])
    elif extended and major == 4:
        at = max(6, _synchsafe(tag[:4].ljust(4, b"\0")))
    while at + 6 <= len(tag) and tag[at] and major == 2 and not extended:  # three letters, three bytes of size, no flags; the bit is for packing there
        name, size = tag[at : at + 3].decode("latin-1"), int.from_bytes(tag[at + 3 : at + 6])
        _text_frame(name, tag[at + 6 : at + 6 + size], tags)
        at += 6 + size
    while at + 10 <= len(tag) and tag[at] and major >= 3:
        name, raw = tag[at : at + 4].decode("latin-1"), tag[at + 4 : at + 8]
        size = _synchsafe(raw) if major == 4 else int.from_bytes(raw)
        _text_frame(name, _frame_body(major, tag[at + 9], tag[at + 10 : at + 10 + size], apart), tags)
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0)


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """Xing, Info or VBRI table of the first frame."""
    x = at + 4 + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, p, out = int.from_bytes(data[x + 4 : x + 8]), x + 8, {"kind": data[x : x + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = int.from_bytes(data[p : p + 4])
                p += 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    if data[at + 36 : at + 40] == b"VBRI" and len(data) >= at + 62:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[at + 46 : at + 60])
        entries = min(entries, (len(data) - at - 62) // width if width else 0)  # those that are there
        toc = [scale * int.from_bytes(data[at + 62 + k * width : at + 62 + (k + 1) * width]) for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


def parse(data: bytes) -> Media:
    """Walk all frames. Lost sync is found again at the next header whose follower is a like header, or the end.

    Bytes in between are counted, not guessed; empty input gives no frames, and any bytes at all give some result.
    Checksums are verified for all layers; a protected frame that is too short for what they cover counts as unchecked.
    """
    m, end = Media(), len(data)
    at = _id3v2(data, m.tags)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if value := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                m.tags.setdefault(key, value)
    first, like = True, None
    time: dict[int, int] = {}
    while at + 4 <= end:
        h = header(data[at : at + 4])
        if h is not None and (at + h.length > end or (like and (h.version, h.layer, h.rate) != like)):
            h = None
        if h is not None and like is None:  # not in step yet: the next frame must follow, or the end
            then = header(data[at + h.length : at + h.length + 4])
            if at + h.length != end and (then is None or (then.version, then.layer, then.rate) != (h.version, h.layer, h.rate)):
                h = None
        if h is None:
            step = data.find(b"\xff", at + 1, end)
            to = step if step >= 0 else end
            m.resyncs += like is not None
            m.skipped += to - at
            at, like = to, None
            continue
        like = (h.version, h.layer, h.rate)
        if first:
            first, m.rate = False, h.rate
            if h.layer == 3 and (found := _vbr(data, at, h)):
                m.vbr = found
                at += h.length
                continue
        if h.protected:
            if (covered := checked_bits(data[at : at + h.length], h)) is not None:
                good = crc16_bits(*covered) == data[at + 4] << 8 | data[at + 5]
                m.crc_good += good
                m.crc_bad += not good
            else:
                m.crc_unchecked += 1
        m.offsets.append(at)
        m.sizes.append(h.length)
        m.kbps[h.kbps] = m.kbps.get(h.kbps, 0) + 1
        time[h.rate] = time.get(h.rate, 0) + h.samples
        at += h.length
    m.skipped += max(0, end - at) if at < end else 0
    m.duration = sum((Fraction(n, r) for r, n in time.items()), Fraction(0))
    return m


# Layout of written media: version 1, layer III, 32 kHz, mono, protected frames.
RATE, SIDE, ROOM = 32000, 17, 4 + 2 + 17
_BY_ROOM = [(144 * k * 1000 // RATE - ROOM, i) for i, k in enumerate(KBPS[1, 3]) if i]


@functools.lru_cache(maxsize=32)
def _head(index: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, index << 4 | 2 << 2, 0xC0))


@functools.lru_cache(maxsize=32)
def _frame_start(index: int) -> bytes:
    """Header, checksum and zero side information: the frame decodes to silence, its other bytes are ancillary data."""
    head = _head(index, True)
    return head + crc16(head[2:] + bytes(SIDE)).to_bytes(2) + bytes(SIDE)


def store(payload: bytes) -> bytes:
    """An MPEG stream that holds the payload, byte by byte, as ancillary data of silent frames.

    All frames have the top bitrate but the last, which has the lowest that fits; so a Xing table comes first. The
    payload's length is in an ID3v2 text, and an ID3v1 tag ends the stream.
    """
    most, top = _BY_ROOM[-1]
    body = bytearray()
    offsets = []
    for a in range(0, len(payload), most):
        part = payload[a : a + most]
        room, index = (most, top) if len(part) == most else next(x for x in _BY_ROOM if x[0] >= len(part))
        offsets.append(len(body))
        body += _frame_start(index) + part + bytes(room - len(part))
    first_size = 144
    total = first_size + len(body)
    toc = bytes(min(255, 256 * (first_size + offsets[k * len(offsets) // 100]) // total) for k in range(100)) if offsets else bytes(100)
    xing = (_head(1, False) + bytes(SIDE) + b"Xing" + struct.pack(">III", 7, len(offsets), total) + toc).ljust(first_size, b"\0")
    text = b"\0payload_bytes\0" + str(len(payload)).encode()
    frame = b"TXXX" + len(text).to_bytes(4) + b"\0\0" + text
    return b"ID3\x04\0\0" + bytes((0, 0, len(frame) >> 7, len(frame) & 127)) + frame + xing + body + (b"TAG" + b"payload").ljust(128, b"\0")


def read_back(data: bytes, m: Media) -> bytes:
    """The payload that :func:`store` put into the frames."""
    return b"".join([data[a + ROOM : a + n] for a, n in zip(m.offsets, m.sizes, strict=True)])[: int(m.tags.get("payload_bytes", 0))]


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + bytes([PAD]) * (-len(raw) % BLOCK if raw else BLOCK)


def features(payload: bytes, m: Media) -> str:
    x = np.frombuffer(payload, np.uint8)
    sums = np.bincount(x, minlength=256)
    mean = int((sums * np.arange(256)).sum()) * 1000 // max(1, len(x))
    return (
        f"duration={m.duration.numerator}/{m.duration.denominator};frames={len(m.offsets)};rate={m.rate};"
        f"kbps={','.join(f'{k}x{n}' for k, n in sorted(m.kbps.items()))};crc={m.crc_good}/{m.crc_bad};skipped={m.skipped};"
        f"vbr={m.vbr['kind'] if m.vbr else 'none'}:{(m.vbr or {}).get('frames', 0)};"
        f"seek={zlib.crc32(np.array(m.offsets, '<i8').tobytes())};mean={mean};levels={int((sums > 0).sum())}"
    )


MEDIA_SCHEMA = (
    "duration double, duration_num long, duration_den long, frames long, rate int, offsets array<long>, crc_good long, crc_bad long, "
    "crc_unchecked long, skipped long, resyncs long, vbr_kind string, vbr_frames long, vbr_toc array<int>, tags map<string,string>"
)


def inspect(media: DataFrame, column: str = "media") -> DataFrame:
    """Each row with a struct ``audio`` of its MPEG stream: exact duration, seek offsets, checksums, tags, VBR table.

    A null or empty value has no frames and duration 0; repeated values have equal results; a stream of any length is
    one row, with 8 bytes a frame. An empty table gives an empty result. A column of media that is named ``audio`` gives
    way to the new one; all others pass through.
    """
    arrow_rows(media.sparkSession, 200)

    @F.pandas_udf(MEDIA_SCHEMA)
    def audio(data: pd.Series) -> pd.DataFrame:
        found = [parse(bytes(x) if x is not None else b"") for x in data]
        return pd.DataFrame({
            "duration": [float(m.duration) for m in found], "duration_num": [m.duration.numerator for m in found],
            "duration_den": [m.duration.denominator for m in found], "frames": [len(m.offsets) for m in found], "rate": [m.rate for m in found],
            "offsets": [m.offsets for m in found], "crc_good": [m.crc_good for m in found], "crc_bad": [m.crc_bad for m in found],
            "crc_unchecked": [m.crc_unchecked for m in found], "skipped": [m.skipped for m in found], "resyncs": [m.resyncs for m in found],
            "vbr_kind": [(m.vbr or {}).get("kind") for m in found], "vbr_frames": pd.array([(m.vbr or {}).get("frames") for m in found], "Int64"),
            "vbr_toc": [(m.vbr or {}).get("toc") for m in found], "tags": [m.tags for m in found],
        })

    return media.withColumn("audio", audio(F.col(column)))


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Texts as payloads: stored as MPEG audio, parsed, read back and described. Equal texts give equal values.

    A null text counts as empty, which is one block of padding; a null doc_id stays null. Repeated rows give a row each,
    texts of any length are stored whole, and an empty table gives an empty result. Other columns are not read.
    """
    arrow_rows(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text in b["text"]:
                n, payload = pad(text)
                data = store(payload)
                m = parse(data)
                back = read_back(data, m)
                rows.append((
                    n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(back, m),
                ))
            out = pd.DataFrame(rows, columns=["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
            out.insert(0, "doc_id", b["doc_id"].to_numpy())
            yield out

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, schema)
