"""Sampled segmentations over the piece lattice of a SentencePiece vocabulary; decoding is lossless.

Every segmentation of a text into pieces is a path in the lattice of its characters. A path is drawn with a probability
in proportion to the product of its pieces' weights: a forward pass sums the weights of all paths to each place
(filtering), and a backward pass draws the last piece, then the piece before it, and so on (sampling). Draws depend on
the row's key only, so a row has the same segmentation in any batch, task or run.
"""

from __future__ import annotations

import functools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, whole_row

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = 0x2581  # the sign that stands for a space within pieces
#: Rank offset of the Zipf-Mandelbrot weights (pieces of a merge vocabulary have ranks, not probabilities).
RANK_OFFSET = 2.7
#: Weight of a character that is no piece, per lattice edge; such characters become byte pieces.
FALLBACK = 1e-7
#: Characters that are worked on at once; a longer text goes part by part, so memory does not depend on its length.
LOT = 1 << 19
#: A run without spaces is cut after so many characters (LOT is a multiple); no piece goes beyond a cut.
RUN = 1 << 12
#: Ids that are decoded at once.
DECODED = 1 << 16
_U = np.uint64
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def splitmix(x: np.ndarray) -> np.ndarray:
    """The SplitMix64 mixing function, on arrays."""
    x = x + _U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class Vocabulary:
    """Pieces of a model file, their weights, and a hash table of all their prefixes for lookups on arrays."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.bytes_of: list[bytes] = [b""] * n
        self.byte_ids = np.zeros(256, np.int32)
        pieces: dict[str, int] = {}
        scores = np.array([sp.get_score(i) for i in range(n)])
        rank = np.empty(n)
        rank[np.argsort(-scores, kind="stable")] = np.arange(n)
        for i in range(n):
            if sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                continue
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(p[1:-1], 16)] = i
                self.bytes_of[i] = bytes([int(p[1:-1], 16)])
            else:
                pieces[p] = i
                self.bytes_of[i] = p.replace(chr(SPACE), " ").encode()
        self.flat = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.size = np.fromiter(map(len, self.bytes_of), np.int64, n)
        self.begin = np.cumsum(self.size) - self.size
        self.longest = max(map(len, pieces))
        self.weight = ((rank + RANK_OFFSET) ** -alpha).astype(np.float64)
        self.space_id = pieces[chr(SPACE)]
        # prefixes: value is the piece id, or -1 for a prefix that is no piece
        prefixes: dict[str, int] = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                prefixes.setdefault(p[:k], -1)
            prefixes[p] = i
        keys = np.array([self._hash(p) for p in prefixes], np.uint64)
        values = np.array(list(prefixes.values()), np.int32)
        self.bits = int(len(keys) * 4).bit_length()
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -2, np.int32)
        slots = (keys >> _U(64 - self.bits)).astype(np.int64)
        for k, v, s in zip(keys.tolist(), values.tolist(), slots.tolist(), strict=True):
            while self.keys[s]:
                s = s + 1 & (1 << self.bits) - 1
            self.keys[s], self.values[s] = k, v

    @staticmethod
    def _hash(p: str) -> int:
        h, power = 0, 1
        for m in splitmix(np.array([ord(c) for c in p], np.uint64)).tolist():
            h, power = h + m * power & _MASK, power * _BASE & _MASK
        return int(_finish(np.array([h], np.uint64))[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece id, -1 for a mere prefix, -2 for neither."""
        slot = (h >> _U(64 - self.bits)).astype(np.int64)
        k = self.keys[slot]
        out = np.where(k == h, self.values[slot], np.int32(-2))
        left = np.flatnonzero((k != h) & (k != 0))
        while len(left):
            slot[left] = slot[left] + 1 & (1 << self.bits) - 1
            k = self.keys[slot[left]]
            hit = k == h[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (k != 0)]
        return out


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    h = h ^ (h >> _U(32))
    return np.where(h == 0, _U(1), h)


@functools.lru_cache(maxsize=4)
def vocabulary(path: str, alpha: float) -> Vocabulary:
    return Vocabulary(path, alpha)


def _lattice(v: Vocabulary, cps: np.ndarray, sums: np.ndarray, inverse: np.ndarray, start: np.ndarray, size: np.ndarray):
    """Forward filtering over distinct chunks, longest first.

    A place is the gap after a chunk's first e characters. Places of equal e lie together, in the order of the chunks,
    so that a sum over last pieces reads plain stretches of the places before. Returns level (the first place of each e),
    cum (places x lengths: cumulated probability of the last piece's length, in whole words of 8 columns)
    and ids (places x lengths: that piece; -1 - c for a character c that becomes bytes).
    """
    most = v.longest
    deep = int(size[0]) if len(size) else 0
    wide = np.searchsorted(-size, -np.arange(1, deep + 1), side="right")  # chunks of at least so many characters
    level = np.concatenate(([0, len(size)], len(size) + np.cumsum(wide)))
    places = int(level[-1])
    ids = np.zeros((places, most), np.int32)
    weight = np.zeros((most, places), np.float32)
    # chunk-major list of characters, by what comes before them in the chunk
    chunk = np.repeat(np.arange(len(size)), size)
    inner = np.arange(len(chunk)) - np.repeat(np.cumsum(size) - size, size)
    at = start[chunk] + inner  # character in the batch
    room = size[chunk] - inner
    before, scale = sums[at], inverse[at]
    for n in range(1, most + 1):
        if n > 1:
            live = found > -2
            live &= room > n - 1
            live = np.flatnonzero(live)
            chunk, inner, at, room, before, scale = (x[live] for x in (chunk, inner, at, room, before, scale))
        if not len(at):
            break
        found = v.find(_finish((sums[at + n] - before) * scale))
        end = level[inner + n] + chunk
        hit = found >= 0
        ids[end[hit], n - 1] = found[hit]
        weight[n - 1, end[hit]] = v.weight[found[hit]]
        if n == 1:
            miss = ~hit
            ids[end[miss], 0] = -1 - cps[at[miss]].astype(np.int64)
            weight[0, end[miss]] = FALLBACK
    cum = np.ones((places, -(-most // 8) * 8), np.float32)
    total = np.zeros(places)
    total[: len(size)] = 1.0
    for e, n in enumerate(wide.tolist(), 1):
        here = int(level[e])
        w = min(e, most)
        # scaled by character, which all paths to a place share; so sums stay near 1
        terms = weight[:w, here : here + n] * _SCALE[:w, None]
        if n < w:
            terms *= total[level[e - w : e][::-1, None] + np.arange(n)]
        else:
            for k, a in enumerate(level[e - w : e][::-1].tolist()):
                terms[k] *= total[a : a + n]
        # one after the other, so that a chunk's sums do not depend on others
        for k in range(1, w):
            terms[k] += terms[k - 1]
        whole = terms[w - 1].copy()
        total[here : here + n] = whole
        terms /= whole
        cum[here : here + n, :w] = terms.T
        if whole.min() < 1e-120 or whole.max() > 1e120:
            odd = np.flatnonzero((whole < 1e-120) | (whole > 1e120))
            total[level[e - w + 1 : e + 1][:, None] + odd] /= whole[odd]
    return level, cum, ids


_SCALE = 12.0 ** np.arange(1, 257)


def parts(text: str) -> list[tuple[int, str]]:
    """The text with the space that goes before it, as SentencePiece has it, in (offset, part) of at most LOT characters.

    A part ends where a chunk does: before a run of spaces, or in a run without spaces at a multiple of RUN.
    """
    if not text:
        return []
    whole, a, out = " " + text, 0, []
    while len(whole) - a > LOT:
        b = a + LOT
        while b > a and not (whole[b] == " " and whole[b - 1] != " "):
            b = whole.rfind(" ", a, b)
        out.append((a, whole[a : b if b > a else a + LOT]))
        a = b if b > a else a + LOT
    return [*out, (a, whole[a:])]


def lots(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Lots of (text number, offset, part), LOT characters and a part less one at most."""
    out: list[list[tuple[int, int, str]]] = []
    held = LOT
    for k, t in enumerate(texts):
        for offset, part in parts(t):
            if held + len(part) > LOT:
                out.append([])
                held = 0
            out[-1].append((k, offset, part))
            held += len(part)
    return out


def sample(texts: list[str], keys: np.ndarray, v: Vocabulary, seed: int = 0) -> list[np.ndarray]:
    """Sampled piece ids of each text; the draws of a text depend on its key and the seed only."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    for lot in lots(texts):
        who = np.array([k for k, _, _ in lot])
        for (k, _, _), ids in zip(lot, _sample([p for _, _, p in lot], keys[who], np.array([a for _, a, _ in lot]), v, seed), strict=True):
            found[k].append(ids)
    return [x[0] if len(x) == 1 else np.concatenate([np.zeros(0, np.int32), *x]) for x in found]


def _sample(texts: list[str], keys: np.ndarray, offset: np.ndarray, v: Vocabulary, seed: int) -> list[np.ndarray]:
    """Piece ids of parts of texts (none empty), which begin at ``offset`` of their text."""
    raw = [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in texts]
    sizes = np.array([len(x) for x in raw], np.int64)
    cps = np.concatenate(raw).astype(np.int64)
    # a text's own U+2581 is kept apart, as bytes
    code = np.where(cps == 32, SPACE, np.where(cps == SPACE, 0x110000, cps))
    n = len(code)
    power = np.full(n + 1, _U(_BASE))
    power[0] = 1
    inverse = np.full(n + 1, _U(_INVERSE))
    inverse[0] = 1
    power, inverse = np.cumprod(power, dtype=np.uint64), np.cumprod(inverse, dtype=np.uint64)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(splitmix(code.astype(np.uint64)) * power[:-1], dtype=np.uint64)))
    # a chunk is a run of spaces with what follows it, RUN characters at most; pieces never go beyond one
    doc_at = np.concatenate(([0], np.cumsum(sizes)))
    space = code == SPACE
    begins = space & ~np.concatenate(([False], space[:-1]))
    begins[doc_at[:-1]] = True
    del code, space
    start = np.flatnonzero(begins)
    wide = np.flatnonzero(np.diff(np.append(start, n)) > RUN)
    for a in start[wide].tolist():
        b = int(start[np.searchsorted(start, a, side="right")]) if a < start[-1] else n
        begins[a:b:RUN] = True
    start = np.flatnonzero(begins)
    size = np.diff(np.append(start, n))
    h = splitmix((sums[start + size] - sums[start]) * inverse[start] + size.astype(np.uint64))
    _, one, which = np.unique(h, return_index=True, return_inverse=True)
    order = np.argsort(-size[one], kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    which = rank[which]
    one = one[order]
    level, cum, ids = _lattice(v, cps, sums, inverse, start[one], size[one])
    # backward sampling, all chunks of the batch a piece at a time
    doc = np.searchsorted(doc_at, start, side="right") - 1
    stream = splitmix(splitmix(keys.astype(np.int64).view(np.uint64) ^ _U(seed))[doc] + (start - doc_at[doc] + offset[doc]).astype(np.uint64) * _U(_BASE))
    live = np.arange(len(start))
    left = size  # characters of each live chunk that are not yet taken
    count = np.zeros(len(start), np.int64)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        p = level[left] + which
        u = (splitmix(stream + _U(len(steps) + 1)) >> _U(40)).astype(np.float32) * np.float32(2.0**-24)
        # eight comparisons in a word, so a word's bits are counted
        k = np.bitwise_count((cum[p] <= u[:, None]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        k = np.minimum(k, ids.shape[1] - 1)
        steps.append((live, ids[p, k]))
        left = left - k - 1
        on = left > 0
        count[live[~on]] = len(steps)
        live, left, which, stream = (x[on] for x in (live, left, which, stream))
    last = np.cumsum(count) - 1
    flat = np.empty(int(count.sum()), np.int32)
    for s, (who, piece) in enumerate(steps):
        flat[last[who] - s] = piece
    flat, wide = _bytes(flat, v)
    ends = np.cumsum(np.bincount(doc, weights=count, minlength=len(texts)).astype(np.int64))
    return np.split(flat, (ends if wide is None else np.cumsum(wide)[ends - 1])[:-1])


def _bytes(ids: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray | None]:
    """Characters that are no piece, as byte pieces; and how many ids each has become, None if all stay."""
    at = np.flatnonzero(ids < 0)
    if not len(at):
        return ids, None
    char = -1 - ids[at]
    many = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
    wide = np.ones(len(ids), np.int64)
    wide[at] = many
    out = np.repeat(ids, wide)
    first = (np.cumsum(wide) - wide)[at]
    for n, lead in enumerate((0, 0xC0, 0xE0, 0xF0), 1):  # UTF-8 of n bytes
        c, a = char[many == n], first[many == n]
        out[a] = v.byte_ids[lead | c >> 6 * (n - 1)]
        for k in range(1, n):
            out[a + k] = v.byte_ids[0x80 | c >> 6 * (n - 1 - k) & 0x3F]
    return out, wide


def decode(ids, v: Vocabulary) -> str:
    """The text of ids: bytes of all pieces, without the space that encoding puts first."""
    held, ids = [], np.asarray(ids, np.int64)
    for a in range(0, len(ids), DECODED):
        part = ids[a : a + DECODED]
        size = v.size[part]
        at = np.repeat(v.begin[part] - (np.cumsum(size) - size), size)
        at += np.arange(len(at))
        held.append(v.flat[at].tobytes())
    return b"".join(held)[1:].decode()


def encode(docs: DataFrame, key: str = "doc_id", path: str = VOCABULARY, alpha: float = 0.5, seed: int = 0) -> DataFrame:
    """docs with piece_ids array<int>, n_pieces and lossless (the ids decode to the very text).

    alpha sharpens (above 1) or flattens the distribution. A null or empty text has no pieces. A null key counts as 0;
    rows with equal key and text have equal pieces. Texts of any length and any characters, U+2581 and controls
    included, decode to themselves; memory is that of LOT characters, and of the text and its ids. An empty table gives
    an empty result. Of docs' own columns, those named like a new one give way to it; all others pass through.
    """
    arrow_rows(docs.sparkSession)

    @F.pandas_udf("piece_ids array<int>, n_pieces int, lossless boolean")
    def pieces(text: pd.Series, row_key: pd.Series) -> pd.DataFrame:
        v = vocabulary(path, alpha)
        texts = text.tolist()
        ids = sample(texts, row_key.to_numpy(np.int64), v, seed)
        return pd.DataFrame({
            "piece_ids": ids, "n_pieces": [len(x) for x in ids],
            "lossless": [decode(x, v) == t for x, t in zip(ids, texts, strict=True)],
        })

    new = ("piece_ids", "n_pieces", "lossless")
    row = whole_row(docs.drop(*new))
    found = docs.select(row, pieces(F.coalesce("text", F.lit("")), F.coalesce(F.col(key), F.lit(0)).cast("long")).alias("__new"))
    return found.select("__row.*", "__new.*")


def decode_column(rows: DataFrame, ids: str = "piece_ids", path: str = VOCABULARY) -> DataFrame:
    """rows with the decoded ``text``; null ids give an empty text."""

    @F.pandas_udf("string")
    def text(x: pd.Series) -> pd.Series:
        v = vocabulary(path, 1.0)
        return pd.Series(["" if i is None else decode(i, v) for i in x], dtype=object)

    return rows.withColumn("text", text(F.col(ids)))


def op3(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return encode(docs.select("doc_id", "text")).select("doc_id", "n_pieces", "piece_ids", "lossless")
