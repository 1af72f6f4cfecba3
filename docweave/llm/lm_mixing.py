"""Language-model scores by logistic context mixing over bits, beside a smoothed unigram score.

A text is its lower-cased words and an end. Each token is a few yes-no decisions on the way down a Huffman tree of the
training texts' frequent words; all other words share one leaf and are then spelt, byte by byte, down a Huffman tree of
bytes. Bit predictors bet on each decision, each from what it has seen in its own context, hashed into a table of bit
counts: for words none, the word before, and the last very frequent word before; for bytes the last two and four of
the word, and the word so far. Their logits are summed by weights that a gate selects from what the predictors know.

Counts are of all training texts. What a pair of counts means is read off the tables, and the weights are learnt online
over all training texts, in both cases with a decision's own occurrence taken out
of the contexts' counts. While a text is scored, it
has a factor of its own for each predictor's weights, which is refined by its errors, first after FIRST tokens, then at
doubling distances, at most EVERY apart.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, discard, materialize

END = "\n"  # the end's token; no word is one
SPACE = 32
#: A word with more than one in HEAD of all training tokens is a head word; so head words are fewer than HEAD.
HEAD = 1_000_000
#: Longer words, in bytes, are no head words, so all of them together are below HEAD * HEAD_BYTES bytes, and go by a digest.
HEAD_BYTES = 48
#: Leaves that are no head words: any other word, and the end.
OTHER, END_ID, WORD_0 = 0, 1, 2
#: The word before, where there is none.
NONE = -1
#: Very frequent words: the first so many.
FREQUENT = 256
#: Slots of the tables, as powers of two, at most; sized by the corpus below that, a slot a training token and PER_WORD a head word.
MOST_BITS, PER_WORD = (23, 22), 64
#: The same for bytes, where tables are sized by the distinct words.
BYTE_BITS = (18, 21, 22)
#: Tags of a slot: not used, used by more than one context; others name the context.
EMPTY, MIXED, TAG_BITS = 0, 1, 8
DEPTHS = 4
#: Weights a gate selects: which of two predictors know the context, and how deep in the tree; for bytes likewise.
GATES = 4 * DEPTHS
PREDICTORS = 3
#: Tokens of a block, which are worked on at once; tokens of the first segment and of later ones at most.
BLOCK, FIRST, EVERY = 1 << 14, 32, 512
#: Tokens whose kinds are found at once, and kinds that are worked on at once.
LOT = 1 << 20
#: Training tokens whose kinds meet in one task, as a power of two; tasks at least; buckets of kinds a task, and kinds of a row.
MEET_BITS, MEET_LEAST, BUCKETS, ROW = 21, 4, 4, 1 << 18
#: Training tokens whose kinds are counted in one table, as a power of two; bytes of words that are spelt at once.
TABLE_BITS, SPELT = 24, 1 << 19
PRIOR, RATE_DOC, SLOW_DOC = 100.0, 4.0, 400.0
#: Bytes of text whose words a task counts before it hands them on; slots of a chunk of a table.
FLUSH_BYTES, CHUNK = 1 << 25, 1 << 16
#: Logits of frozen tables are whole numbers of so many parts, below MOST.
UNIT, MOST = 14, 128
#: Bits of a leaf, which is below HEAD + 2, and of a very frequent word or none.
LEAF_BITS, OFTEN_BITS = 20, 9
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
#: Levels of a tree whose slots lie near each other.
NEAR = 4
_A, _B, _C = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
_UNDO_B = pow(0x85EBCA6B, -1, 1 << 32)


# ---------------------------------------------------------------- trees


@dataclass
class Tree:
    """Decisions of each leaf: flat arrays of nodes (hashed and plain) and answers, with where a leaf's begin and end."""

    start: np.ndarray
    length: np.ndarray
    node: np.ndarray
    mark: np.ndarray
    bit: np.ndarray
    sign: np.ndarray
    depth: np.ndarray
    nodes: int

    @classmethod
    def of(cls, counts: np.ndarray, bits: int = 0) -> Tree:
        """bits: of the smallest table, if decisions of one context that follow each other shall have slots near each other there."""
        n = len(counts)
        heap = [(float(c) + 0.5, k) for k, c in enumerate(counts)]
        heapq.heapify(heap)
        up, side = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8)
        new = n
        while len(heap) > 1:
            a, b = heapq.heappop(heap), heapq.heappop(heap)
            up[a[1]] = up[b[1]] = new
            side[b[1]] = 1
            heapq.heappush(heap, (a[0] + b[0], new))
            new += 1
        # all leaves climb together
        at, steps = np.arange(n), []
        while (live := at != new - 1).any():
            steps.append((np.where(live, up[at] - n, -1), np.where(live, side[at], 0)))
            at = np.where(live, up[at], at)
        length = sum(((x >= 0).astype(np.int64) for x, _ in steps), np.zeros(n, np.int64))
        start = np.cumsum(length) - length
        node, bit = np.zeros(int(length.sum()), np.int32), np.zeros(int(length.sum()), np.uint8)
        for k, (x, y) in enumerate(steps):
            who = np.flatnonzero(x >= 0)
            node[start[who] + length[who] - 1 - k], bit[start[who] + length[who] - 1 - k] = x[who], y[who]
        depth = (np.arange(len(node)) - np.repeat(start, length)).astype(np.uint8)
        top, way = node, np.zeros(len(node), np.uint32)
        if bits:  # NEAR levels share the mark of the highest, and add their way down from it, in slots
            at = np.arange(len(node)) - depth % NEAR
            top, way = node[at], np.ones(len(node), np.uint32)
            for k in range(NEAR - 1):
                way = np.where(depth % NEAR > k, 2 * way + bit[np.minimum(at + k, len(node) - 1)], way)
            way = way.astype(np.uint32) * np.uint32((1 << 32 - bits) * _UNDO_B & 0xFFFFFFFF)
        mark = top.astype(np.uint32) * _A
        mark ^= mark >> np.uint32(15)
        mark += way
        return cls(start.astype(np.int32), length.astype(np.int32), node, mark, bit, (2 * bit.astype(np.int8) - 1), np.minimum(depth >> 2, DEPTHS - 1).astype(np.uint8), max(1, new - n))

    @functools.cached_property
    def level(self) -> np.ndarray:
        """Depth of each decision, those whose answer is yes after all others."""
        return self.depth + np.uint8(DEPTHS) * self.bit

    def walk(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of decisions of each leaf, all decisions in order as places of the flat arrays)."""
        many = self.length[leaf]
        first = np.cumsum(many, dtype=np.int64) - many
        flat = np.repeat(self.start[leaf] - first, many)
        flat += np.arange(len(flat))
        return many, flat

    def bases(self, counts: np.ndarray) -> np.ndarray:
        """Logit of each decision towards its answer, by how often its node was answered either way.

        Its own occurrence stays in: both ways of a Huffman node are about as frequent, so that without it the rarer
        answer would always be the true one. Leaves are frequent words, where one occurrence more hardly counts.
        """
        seen = np.zeros((self.nodes, 2))
        np.add.at(seen, (self.node, self.bit), np.repeat(np.asarray(counts, float), self.length))
        this, other = seen[self.node, self.bit], seen[self.node, 1 - self.bit]
        return np.clip(np.log((this + 0.3) / (other + 0.3)), -12, 12).astype(np.float32)


# ---------------------------------------------------------------- tables


def code(n: np.ndarray) -> np.ndarray:
    """Counts in a byte: exact to 32, then eight steps a doubling."""
    return np.where(n <= 32, n, np.minimum(255, 32 + np.rint(8 * np.log2(np.maximum(n, 32) / 32)))).astype(np.uint32)


def _decoded() -> np.ndarray:
    k = np.arange(256)
    return np.where(k <= 32, k, 32.0 * 2 ** ((k - 32) / 8))


_VALUE = _decoded()
#: First guess of the logit of a pair of coded counts (zeros times 256, plus ones); 0 where nothing is known.
BET = np.clip(np.log((_VALUE[None, :] + 0.3) / (_VALUE[:, None] + 0.3)), -8, 8).ravel()


def places(context: np.ndarray, mark: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Slot and tag of decisions from the hashes of their contexts and nodes."""
    x = context + mark
    tag = x * _C
    tag >>= np.uint32(32 - TAG_BITS)
    tag = tag.astype(np.uint8)
    np.maximum(tag, np.uint8(2), out=tag)
    x *= _B
    x >>= np.uint32(32 - bits)
    return x.astype(np.intp), tag


class Counts:
    """Bit counts by slot, with the tag of the context that uses it; sums of tables do not depend on any order."""

    def __init__(self, bits: int, kind=np.uint32):
        self.bits, self.n, self.tag = bits, np.zeros(2 << bits, kind), np.zeros(1 << bits, np.uint8)

    def add(self, context: np.ndarray, mark: np.ndarray, bit: np.ndarray, by: np.ndarray | None = None) -> None:
        slot, tag = places(context, mark, self.bits)
        np.add.at(self.n, 2 * slot + bit, self.n.dtype.type(1) if by is None else by)
        now = self.tag.take(slot)
        if len(new := np.flatnonzero(now == EMPTY)):
            self.tag[slot[new]] = tag[new]
            now[new] = self.tag[slot[new]]
        self.tag[slot[now != tag]] = MIXED

    def pieces(self, table: int) -> Iterator[dict]:
        for a in range(0, 1 << self.bits, CHUNK):
            n, tag = self.n[2 * a : 2 * (a + CHUNK)], self.tag[a : a + CHUNK]
            if tag.any():
                yield {"chunk": table << 20 | a // CHUNK, "n": packed(n, tag)}

    def frames(self, table: int) -> Iterator[pd.DataFrame]:
        """Pieces, 16 in a frame."""
        pieces = self.pieces(table)
        while some := list(itertools.islice(pieces, 16)):
            yield pd.DataFrame(some)


def packed(n: np.ndarray, tag: np.ndarray) -> bytes:
    """Counts and tags of a chunk in few bytes: a byte a count, and the few large ones apart."""
    large = np.flatnonzero(n >= 255)
    raw = (len(large).to_bytes(4, "little"), large.astype("<u4").tobytes(), n[large].astype("<u8").tobytes(), np.minimum(n, 255).astype(np.uint8).tobytes(), tag.tobytes())
    return zlib.compress(b"".join(raw), 1)


def unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zlib.decompress(raw)
    k = int.from_bytes(raw[:4], "little")
    at, size = 4 + 12 * k, (len(raw) - 4 - 12 * k) // 3
    n = np.frombuffer(raw, np.uint8, 2 * size, at).astype(np.int64)
    n[np.frombuffer(raw, "<u4", k, 4)] = np.frombuffer(raw, "<u8", k, 4 + 4 * k)
    return n, np.frombuffer(raw, np.uint8, size, at + 2 * size)


def summed(parts: DataFrame) -> DataFrame:
    """Chunks of tables summed over tasks, coded: a stream of pieces each, one sum per chunk in memory."""

    def total(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for chunk, raw in zip(b["chunk"], b["n"], strict=True):
                n, tag = unpacked(raw)
                if chunk in held:
                    was = held[chunk]
                    was[0] += n
                    was[1] = np.where(was[1] == EMPTY, tag, np.where((tag == EMPTY) | (tag == was[1]), was[1], MIXED)).astype(np.uint8)
                else:
                    held[chunk] = [n, tag]
        for chunk, (n, tag) in held.items():
            coded = tag.astype(np.uint32) << np.uint32(16) | code(n[0::2]) << np.uint32(8) | code(n[1::2])
            yield pd.DataFrame({"chunk": [chunk], "n": [zlib.compress(coded.astype("<u4").tobytes(), 1)]})

    return parts.repartition("chunk").mapInPandas(total, "chunk int, n binary")


@dataclass
class Table:
    """Coded counts and tags of a predictor, and what its pairs of counts mean; when frozen, logits in place of counts."""

    bits: int
    slots: np.ndarray
    bet: np.ndarray = field(default_factory=lambda: np.concatenate((BET, BET)).astype(np.float32))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"slots": (self.slots.dtype.str, zlib.compress(self.slots.tobytes(), 1))}  # small while it travels

    def __setstate__(self, state: dict) -> None:
        kind, raw = state["slots"]
        self.__dict__ = state | {"slots": np.frombuffer(zlib.decompress(raw), kind)}

    def learn_bet(self, prior: float = 30.0) -> None:
        """How often the answer was yes, by pair of counts without the occurrence itself; apart for mixed slots.

        Each slot with counts (n, y) stands for y answers yes at counts (n, y - 1) and n answers no at (n - 1, y).
        """
        times = np.zeros(1 << 17, np.int64)
        for a in range(0, len(self.slots), 1 << 20):
            part = self.slots[a : a + (1 << 20)]
            times += np.bincount((part >> np.uint32(16) == MIXED) * np.uint32(1 << 16) | part & np.uint32(0xFFFF), minlength=1 << 17)
        seen = np.flatnonzero(times)
        times, kind, no, yes = times[seen], seen >> 16, seen >> 8 & 255, seen & 255
        less = lambda c: np.where(c <= 32, np.maximum(c - 1, 0), c)  # noqa: E731  a code beyond 32 is not exact to one
        tally = np.zeros((2, 1 << 17))
        np.add.at(tally[1], kind << 16 | no << 8 | less(yes), times * _VALUE[yes])
        np.add.at(tally[0], kind << 16 | less(no) << 8 | yes, times * _VALUE[no])
        first = 1 / (1 + np.exp(-np.concatenate((BET, BET))))
        self.bet = np.clip(np.log((tally[1] + prior * first) / (tally[0] + prior * (1 - first))), -9, 9).astype(np.float32)
        self.bet[0] = self.bet[1 << 16] = 0.0

    def frozen(self) -> Table:
        """For scoring: a slot is its tag and a logit in two bytes."""
        logit = np.clip(np.rint(self.bet * UNIT), 1 - MOST, MOST - 1).astype(np.int16)
        logit[logit == 0] = 1
        logit[0] = logit[1 << 16] = 0
        tag = self.slots >> np.uint32(16)
        value = logit[(tag == MIXED) * np.uint32(1 << 16) | self.slots & np.uint32(0xFFFF)] + np.int16(MOST)
        return Table(self.bits, (tag.astype(np.uint16) << np.uint16(8)) | value.view(np.uint16), self.bet)

    def look(self, context: np.ndarray, mark: np.ndarray) -> np.ndarray:
        """Logits (in parts of UNIT) of a frozen table; 0 where nothing is known."""
        slot, tag = places(context, mark, self.bits)
        found = self.slots.take(slot)
        own = (found >> np.uint16(8)).astype(np.uint8)
        known = own == tag
        known |= own == MIXED
        found &= np.uint16(255)
        logit = found.view(np.int16)
        logit -= np.int16(MOST)
        logit *= known
        return logit

    def own_taken_out(self) -> np.ndarray:
        """Logit towards the answer, by 1 << 17 for a mixed slot, 1 << 16 for yes, and the pair of counts, which have it once less."""
        pair = np.arange(1 << 16)
        no, yes = pair >> 8, pair & 255
        less = lambda c: np.where((c >= 1) & (c <= 32), c - 1, c)
        out = [sign * self.bet[kind << 16 | x] for kind in (0, 1) for sign, x in ((-1, less(no) << 8 | yes), (1, no << 8 | less(yes)))]
        return np.concatenate(out).astype(np.float32)

    def without_own(self, context: np.ndarray, mark: np.ndarray, bit: np.ndarray, by: np.ndarray) -> np.ndarray:
        """Logits of decisions that the counts have, each without itself (``by`` is of :meth:`own_taken_out`); 0 where nothing is left."""
        slot, tag = places(context, mark, self.bits)
        found = self.slots.take(slot)
        own = (found >> np.uint32(16)).astype(np.uint8)
        mixed = own == MIXED
        known = own == tag
        known |= mixed
        found &= np.uint32(0xFFFF)
        found |= bit.astype(np.uint32) << np.uint32(16)
        found |= mixed.astype(np.uint32) << np.uint32(17)
        out = by.take(found)
        out *= known
        return out


# ---------------------------------------------------------------- mixing


def first_weights() -> np.ndarray:
    return np.tile(np.array([0.4, 0.3, 0.3], np.float32), (GATES, 1))


def newton(weights: np.ndarray, bend: np.ndarray, gate: np.ndarray, signed: list[np.ndarray], by: np.ndarray | None = None) -> None:
    """One online Newton step of the weights for a block of decisions; ``bend`` is the curvature so far, which grows.

    signed: logits of the predictors, towards what happened.
    """
    order, times = np.argsort(gate.astype(np.uint8), kind="stable"), np.bincount(gate, minlength=GATES)
    x = np.stack([y.take(order) for y in signed])
    z = sum(np.repeat(weights[:, k], times) * x[k] for k in range(PREDICTORS))
    p = 1 / (1 + np.exp(-np.clip(z, -12, 12)))
    wrong, flat = 1 - p, p * (1 - p)
    if by is not None:
        by = by.astype(np.float32).take(order)
        wrong, flat = wrong * by, flat * by
    slope, edge = np.zeros((GATES, PREDICTORS)), np.concatenate(([0], np.cumsum(times)))
    for g in np.flatnonzero(times).tolist():
        y = x[:, edge[g] : edge[g + 1]]
        slope[g] = y @ wrong[edge[g] : edge[g + 1]]
        bend[g] += (y * flat[edge[g] : edge[g + 1]]) @ y.T
    weights += np.linalg.solve(bend, slope[:, :, None])[:, :, 0].astype(np.float32)


def gates(found: list[np.ndarray], depth: np.ndarray) -> np.ndarray:
    """Which weights apply, by whether two predictors know the context, and by depth."""
    gate = depth * np.uint8(4)
    gate += (found[0] != 0).view(np.uint8)
    gate += (found[1] != 0).view(np.uint8) * np.uint8(2)
    return gate.astype(np.intp)


def start_bend() -> np.ndarray:
    return np.tile(PRIOR * np.eye(PREDICTORS), (GATES, 1, 1))


# ---------------------------------------------------------------- words by their bytes


class Speller:
    """Bits of a word that is no head word, by its bytes and the space after them: the same in every text."""

    def __init__(self, tree: Tree, tables: list[Table], weights: np.ndarray):
        self.tree, self.tables, self.weights = tree, tables, weights

    @staticmethod
    def contexts(words: list[bytes]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(bytes, number of the word of each, hashed contexts before each, hash of the word up to each); a space stands before each word."""
        buf = np.frombuffer(b" " + b" ".join(words) + b" ", np.uint8)
        b = buf.astype(np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 1
        start = np.repeat(np.cumsum(size) - size, size)  # place of the space before the word
        at = np.arange(1, len(buf))
        inside = at - 1 - start
        back = lambda k: np.where(inside >= k, b[np.maximum(at - k, 0)], np.uint32(SPACE))
        two = back(1) | back(2) << np.uint32(8)
        four = two | back(3) << np.uint32(16) | back(4) << np.uint32(24)
        powers = np.cumprod(np.full(int(size.max()) + 1, _A), dtype=np.uint32)
        sums = np.concatenate((np.zeros(1, np.uint32), np.cumsum(b[1:] * powers[inside], dtype=np.uint32)))
        whole = sums[at - 1] - sums[start]
        # the bytes of the word so far, this one included, in 64 bits
        powers = np.cumprod(np.full(int(size.max()) + 1, _SPREAD), dtype=np.uint64)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b[1:] + np.uint32(1)) * powers[inside], dtype=np.uint64)))
        begin = sums[at] - sums[start]
        return buf[1:], np.repeat(np.arange(len(words)), size), [(h + np.uint32(k * 0x3C6EF372 & 0xFFFFFFFF)) * _C for k, h in enumerate((two, four, whole))], begin

    def _walk(self, words: list[bytes], n: np.ndarray | None = None):
        """For lots of words: (place of each decision, hashed contexts, flat places of the tree, n of each decision), then what place each byte is.

        Bytes after the same beginning of a word are one place; its n is that of all its words.
        """
        a = 0
        while a < len(words):
            b = held = 0
            for b in range(a, len(words)):
                held += len(words[b]) + 1
                if held >= SPELT:
                    break
            byte, word, contexts, begin = self.contexts(words[a : b + 1])
            order = np.argsort(begin)
            new = np.diff(begin[order], prepend=~begin[order[:1]]) != 0
            first = np.flatnonzero(new)
            times = None if n is None else np.add.reduceat(n[a : b + 1][word[order]], first)
            place = np.empty(len(order), np.intp)
            place[order] = np.cumsum(new) - 1
            byte, contexts = byte[order[first]], [h[order[first]] for h in contexts]
            for x in range(0, len(byte), BLOCK):
                cut = slice(x, x + BLOCK)
                many, flat = self.tree.walk(byte[cut])
                yield x + np.repeat(np.arange(len(many)), many), [np.repeat(h[cut], many) for h in contexts], flat, None if n is None else np.repeat(times[cut], many)
            yield a + word, place, None, None
            a = b + 1

    def count(self, tables: list[Counts], words: list[bytes], n: np.ndarray) -> None:
        for _, contexts, flat, by in self._walk(words, n):
            if flat is not None:
                mark, bit = self.tree.mark.take(flat), self.tree.bit.take(flat)
                for t, h in zip(tables, contexts, strict=True):
                    t.add(h, mark, bit, by)

    def learn(self, words: list[bytes], n: np.ndarray, bend: np.ndarray, by: list[np.ndarray]) -> None:
        for _, contexts, flat, times in self._walk(words, n):
            if flat is not None:
                mark, bit = self.tree.mark.take(flat), self.tree.bit.take(flat)
                found = [t.without_own(h, mark, bit, x) for t, h, x in zip(self.tables, contexts, by, strict=True)]
                gate = gates(found[1:], self.tree.depth.take(flat))
                newton(self.weights, bend, gate, found, times)

    def bits(self, words: list[bytes]) -> np.ndarray:
        out, parts = np.zeros(len(words)), []
        weights = (self.weights.T / UNIT).astype(np.float32)
        for place, contexts, flat, _ in self._walk(words):
            if flat is None:  # place: the word of each byte, contexts: its place
                out += np.bincount(place, np.concatenate(parts).take(contexts), minlength=len(words))
                parts = []
                continue
            mark = self.tree.mark.take(flat)
            found = [t.look(h, mark) for t, h in zip(self.tables, contexts, strict=True)]
            gate = gates(found[1:], self.tree.depth.take(flat))
            z = sum(weights[k].take(gate) * found[k] for k in range(PREDICTORS))
            z *= self.tree.sign.take(flat)
            np.clip(z, -12, 12, out=z)
            parts.append(np.bincount(place - place[0], np.log(1 + np.exp(-z))))
        return out / math.log(2)


def lots(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(words, how often each is there), about SPELT bytes at a time."""
    words: list[bytes] = []
    n: list[np.ndarray] = []
    size = 0
    for b in batches:
        words += b.column("token").cast(pa.binary()).to_pylist()
        n.append(b.column("n").to_numpy())
        size += b.column("token").nbytes
        if size >= SPELT:
            yield words, np.concatenate(n)
            words, n, size = [], [], 0
    if words:
        yield words, np.concatenate(n)


# ---------------------------------------------------------------- texts by their words


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(the lower-cased words of texts one after the other, how many each text has), as :func:`tokens` has them."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, edge = parts.flatten(), parts.offsets.to_numpy()
    full = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0  # white space at either end leaves an empty piece there
    size = np.diff(np.concatenate(([0], np.cumsum(full)))[edge - edge[0]])
    return (words if full.all() else words.filter(pa.array(full))), size


class Words:
    """Leaves of head words."""

    def __init__(self, words: list[bytes]):
        self.leaf = {w: k for k, w in enumerate(words, WORD_0)}

    def leaves(self, words: list[bytes]) -> np.ndarray:
        """The leaf of each token, the end included."""
        out = np.empty(len(words) + 1, np.int32)
        out[:-1] = np.fromiter(map(self.leaf.get, words, itertools.repeat(OTHER)), np.int32, len(words))
        out[-1] = END_ID
        return out

    def sorted_by_leaf(self) -> pa.Array:
        """All head words, by their leaves from WORD_0."""
        return pa.array(list(self.leaf), pa.binary())


def cuts(longest: int) -> np.ndarray:
    """Where segments begin, for a text of ``longest`` tokens; the last number ends it."""
    out, step = [0, FIRST], FIRST
    while out[-1] < longest:
        step = min(2 * step, EVERY)
        out.append(out[-1] + step)
    return np.array(out)


def before(leaf: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each token of texts of the given sizes: the word before, the last very frequent word."""
    first = np.cumsum(size) - size
    prior = np.empty(len(leaf), np.int32)
    prior[1:] = leaf[:-1]
    prior[first] = NONE
    n = np.arange(len(leaf))
    often = (prior >= WORD_0) & (prior < WORD_0 + FREQUENT)
    last = np.maximum.accumulate(np.where(often, n, 0))
    begin = np.repeat(first, size)
    return prior, np.where((last >= begin) & often[last], prior[last], NONE)


def hashed(k: int, x: np.ndarray) -> np.ndarray:
    """Hashes of contexts of the k-th predictor."""
    h = x.astype(np.uint32) * _B + np.uint32((k + 1) * 0x3C6EF372 & 0xFFFFFFFF)
    h ^= h >> np.uint32(13)
    return h * _C


def contexts(leaf: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts before each token of texts of the given sizes."""
    return [hashed(k, x) for k, x in enumerate(before(leaf, size))]


def kinds(leaf: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The kind of each token: itself and what the predictors see before it, in one number."""
    prior, frequent = before(leaf, size)
    key = (prior + 1).astype(np.uint64) << np.uint64(LEAF_BITS + OFTEN_BITS)
    key |= np.maximum(frequent - WORD_0 + 1, 0).astype(np.uint64) << np.uint64(LEAF_BITS)
    key |= leaf.astype(np.uint64)
    return key


def of_kind(key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """(leaf, what stands before) of kinds."""
    frequent = (key >> np.uint64(LEAF_BITS) & np.uint64((1 << OFTEN_BITS) - 1)).astype(np.int32)
    prior = (key >> np.uint64(LEAF_BITS + OFTEN_BITS)).astype(np.int32) - 1
    return (key & np.uint64((1 << LEAF_BITS) - 1)).astype(np.int32), [prior, np.where(frequent > 0, frequent - 1 + WORD_0, NONE)]


def tally(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, the sum of n of each; without n how often it is there)."""
    if n is None:
        key, n = np.unique(key, return_counts=True)
        return key, n.astype(np.uint64)
    order = np.argsort(key)
    key = key[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    return key[first], np.add.reduceat(n[order], first) if len(key) else n


@dataclass
class Model:
    """The tree of words, tables of both hashed contexts, weights, and the speller: of a bounded size.

    base: logit of each decision by the tallies of its node, towards its answer.
    """

    words: Words
    tree: Tree
    base: np.ndarray
    tables: list[Table]
    weights: np.ndarray
    speller: Speller

    def frozen(self) -> Model:
        spell = Speller(self.speller.tree, [t.frozen() for t in self.speller.tables], self.speller.weights)
        return Model(self.words, self.tree, self.base, [t.frozen() for t in self.tables], self.weights, spell)

    def count(self, tables: list[Counts], key: np.ndarray, n: np.ndarray) -> None:
        """Counts kinds, each n times: of each predictor the pairs of context and leaf."""
        leaf, seen = of_kind(key)
        for k, (t, x) in enumerate(zip(tables, seen, strict=True)):
            pair, times = tally((x + 1).astype(np.uint64) << np.uint64(LEAF_BITS) | leaf.astype(np.uint64), n)
            times = times.astype(t.n.dtype)
            for a in range(0, len(pair), BLOCK):
                part = pair[a : a + BLOCK]
                many, flat = self.tree.walk((part & np.uint64((1 << LEAF_BITS) - 1)).astype(np.int32))
                context = hashed(k, (part >> np.uint64(LEAF_BITS)).astype(np.int32) - 1)
                t.add(np.repeat(context, many), self.tree.mark.take(flat), self.tree.bit.take(flat), np.repeat(times[a : a + BLOCK], many))

    def learn(self, key: np.ndarray, n: np.ndarray, bend: np.ndarray, by: list[np.ndarray]) -> None:
        """All tokens teach; those of one kind, which have equal bets, do so at once. Kinds are in no telling order."""
        n = n.astype(np.float32)
        for a in range(0, len(key), BLOCK):
            last, seen = of_kind(key[a : a + BLOCK])
            many, flat = self.tree.walk(last)
            mark, bit = self.tree.mark.take(flat), self.tree.bit.take(flat)
            found = [t.without_own(np.repeat(hashed(k, x), many), mark, bit, y) for k, (t, x, y) in enumerate(zip(self.tables, seen, by, strict=True))]
            gate = gates(found, self.tree.depth.take(flat))
            newton(self.weights, bend, gate, [self.base.take(flat), *found], np.repeat(n[a : a + BLOCK], many))

    def score(self, rows: list[list[bytes]], leaves: list[np.ndarray], rest: list[list[bytes]]) -> np.ndarray:
        """Bits of each text, by a frozen model. A text's score depends on itself and the model only.

        leaves: of each text's tokens; rest: its words that are no head words.
        """
        new = list(set().union(*rest))
        own = dict(zip(new, self.speller.bits(new).tolist(), strict=True)) if new else {}
        return self.score_leaves(leaves) + [math.fsum(map(own.get, r)) for r in rest]

    def score_leaves(self, leaves: list[np.ndarray]) -> np.ndarray:
        """The same without what spelling the words takes that are no head words."""
        bits = np.zeros(len(leaves))
        order = np.argsort([-len(x) for x in leaves], kind="stable")
        a = 0
        while a < len(order):  # texts of like length together, those that go on first
            b = held = 0
            for b in range(a, len(order)):
                held += len(leaves[order[b]])
                if held >= BLOCK:
                    break
            who = order[a : b + 1]
            bits[who] += self._score([leaves[k] for k in who])
            a = b + 1
        return bits

    def _score(self, leaves: list[np.ndarray]) -> np.ndarray:
        size = np.array([len(x) for x in leaves])
        leaf, n = np.concatenate(leaves), len(leaves)
        ctx = contexts(leaf, size)
        first = np.cumsum(size) - size
        bits, edges = np.zeros(n), cuts(int(size[0]))
        factor = np.ones((PREDICTORS, n), np.float32)  # of each predictor's weights, text by text
        weights = self.weights.T.astype(np.float32).copy()
        weights[1:] /= UNIT
        weights = np.concatenate((weights, weights), axis=1)  # by gate, where the answer is no and where it is yes
        weights[1:, :GATES] *= -1
        for s, e in itertools.pairwise(edges.tolist()):
            live = int(np.searchsorted(-size, -s, side="left"))  # texts of more than s tokens
            if not live:
                break
            here = np.minimum(e, size[:live]) - s
            at = np.repeat(first[:live] + s - (np.cumsum(here) - here), here) + np.arange(int(here.sum()))
            many, flat = self.tree.walk(leaf[at])
            edge = np.concatenate(([0], np.cumsum(many)))[np.concatenate(([0], np.cumsum(here)))]
            wide = np.diff(edge)
            mark = self.tree.mark.take(flat)
            found = [t.look(np.repeat(h[at], many), mark) for t, h in zip(self.tables, ctx, strict=True)]
            gate = gates(found, self.tree.level.take(flat))
            bets = [self.base.take(flat), *found]
            z = np.zeros(len(flat), np.float32)
            for k, x in enumerate(bets):
                bets[k] = x = weights[k].take(gate) * x  # towards what happened
                z += x * np.repeat(factor[k, :live], wide) if s else x
            np.clip(z, -12, 12, out=z)
            np.negative(z, out=z)
            # odds against what happened: its probability is 1 / (1 + odds)
            odds = np.exp(z, out=z)
            odds += 1
            bits[:live] += np.add.reduceat(np.log(odds), edge[:-1], dtype=np.float64)
            on = int(np.searchsorted(-size, -e, side="left"))
            if on:  # who goes on learns from this segment
                m = int(edge[on])
                error = 1 - 1 / odds[:m]
                for k, x in enumerate(bets):
                    factor[k, :on] += np.float32(RATE_DOC) * np.add.reduceat(error * x[:m], edge[:on]) / (wide[:on] + np.float32(SLOW_DOC))
        return bits / math.log(2)


# ---------------------------------------------------------------- learning over the cluster


def training(docs: DataFrame) -> DataFrame:
    return docs.select(
        "doc_id", F.coalesce("text", F.lit("")).alias("text"), (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 1).alias("held_out")
    )


def count_tokens(docs: DataFrame) -> DataFrame:
    """(token, n): occurrences over the training rows, ends included; 0 for words of held-out rows only. Counted by task, then summed."""
    held_out = F.col("held_out") if "held_out" in docs.columns else F.lit(False)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bool, list[pa.Array]] = {False: [], True: []}

        def out() -> Iterator[pa.RecordBatch]:
            for held, words in seen.items():
                if words:
                    found = pc.value_counts(pa.chunked_array(words))
                    n = pa.array(np.zeros(len(found), np.int64)) if held else found.field(1)
                    all_words = pa.RecordBatch.from_arrays([found.field(0), n], ["token", "n"])
                    for a in range(0, len(found), 1 << 16):
                        yield all_words.slice(a, 1 << 16)
                    words.clear()

        size = ends = 0
        for b in batches:
            held = b.column("held_out").to_numpy(zero_copy_only=False).astype(bool)
            for kind, words in seen.items():
                if (held == kind).any():
                    words.append(split(b.column("text").filter(pa.array(held == kind)))[0])
            ends += int((~held).sum())
            size += b.column("text").nbytes
            if size >= FLUSH_BYTES:
                yield from out()
                size = 0
        yield from out()
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks
        if ends:
            yield pa.RecordBatch.from_arrays([pa.array([END]), pa.array([ends])], ["token", "n"])

    return docs.select("text", held_out.alias("held_out")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))


def is_head(total: int):
    """Whether a row (token, n) is a head word: frequent, and short enough to be on the driver with all others."""
    return (F.col("n") * HEAD > F.lit(total)) & (F.octet_length("token") <= HEAD_BYTES) & (F.col("token") != END)


def byte_counts(words: DataFrame) -> np.ndarray:
    """How often words (token, n), each with a space after it, have each byte."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(256)
        for b in batches:
            if len(b):
                raw = [t.encode() + b" " for t in b["token"]]
                seen += np.bincount(np.frombuffer(b"".join(raw), np.uint8), np.repeat(b["n"].to_numpy(float), list(map(len, raw))), minlength=256)
        yield pd.DataFrame({"byte": np.arange(256), "n": seen})

    out = np.zeros(256)
    for r in words.mapInPandas(run, "byte int, n double").groupBy("byte").agg(F.sum("n").alias("n")).collect():  # 256 rows
        out[r["byte"]] = r["n"]
    return out


def learn_speller(words: DataFrame) -> Speller:
    """The speller of words (token, n); what reaches the driver is of a fixed size."""
    spark, tree = words.sparkSession, Tree.of(byte_counts(words))
    words = words.select("token", "n")
    fewer = words.coalesce(max(MEET_LEAST, words.rdd.getNumPartitions() // 3))  # a table a task
    fresh = spark.sparkContext.broadcast(Speller(tree, [], first_weights()))

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [Counts(b, np.uint64) for b in BYTE_BITS]
        for some, n in lots(batches):
            fresh.value.count(tables, some, n.astype(np.uint64))
        for k, t in enumerate(tables):
            for frame in t.frames(k):
                yield pa.RecordBatch.from_arrays([pa.array(frame["chunk"], pa.int32()), pa.array(frame["n"], pa.binary())], ["chunk", "n"])

    speller = Speller(tree, tables_of(fewer.mapInArrow(counts, "chunk int, n binary"), BYTE_BITS), first_weights())
    shared = spark.sparkContext.broadcast(speller)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, bend, seen = Speller(shared.value.tree, shared.value.tables, shared.value.weights.copy()), start_bend(), 0
        by = [t.own_taken_out() for t in own.tables]
        for some, n in lots(batches):
            own.learn(some, n.astype(np.float64), bend, by)
            seen += len(some)
        for frame in _weights(own.weights, seen):
            yield pa.RecordBatch.from_pandas(frame.astype({"at": np.int32}), preserve_index=False)

    speller.weights = averaged(words.mapInArrow(weigh, WEIGHTS), speller.weights)
    shared.destroy()
    fresh.destroy()
    return speller


WEIGHTS = "at int, w double, n long"


def _weights(w: np.ndarray, seen: int) -> Iterator[pd.DataFrame]:
    if seen:
        yield pd.DataFrame({"at": np.arange(w.size), "w": w.ravel().astype(np.float64) * seen, "n": seen})


def averaged(parts: DataFrame, otherwise: np.ndarray) -> np.ndarray:
    """Weights of all tasks, each by how much it has seen."""
    out = otherwise.copy()
    for r in parts.groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n")).collect():  # GATES * PREDICTORS rows
        out.flat[r["at"]] = r["w"] / r["n"]
    return out


def tables_of(parts: DataFrame, bits: tuple[int, ...]) -> list[Table]:
    tables = [Table(b, np.zeros(1 << b, np.uint32)) for b in bits]
    for r in summed(parts).toLocalIterator():
        x = np.frombuffer(zlib.decompress(r["n"]), np.uint32)
        a = (r["chunk"] & 0xFFFFF) * CHUNK
        tables[r["chunk"] >> 20].slots[a : a + len(x)] = x
    for t in tables:
        t.learn_bet()
    return tables


LEAVES = "rid long, doc_id long, held_out boolean, n_bytes long, leaves binary, tail array<string>, tf array<int>"


def in_leaves(docs: DataFrame, words: Words) -> DataFrame:
    """Rows (doc_id, text, held_out) as the leaves of their tokens, and their words that are no head words with how often they occur.

    Written once, so that texts are taken apart once for counting, learning and scoring.
    """
    shared = docs.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        rid, heads = TaskContext.get().partitionId() << 40, shared.value.sorted_by_leaf()
        for b in batches:
            words, size = split(b.column("text"))
            coded = words.dictionary_encode()
            code, rows = coded.indices.to_numpy(), np.arange(len(size))
            found = pc.index_in(coded.dictionary.cast(pa.binary()), value_set=heads)
            found = pc.fill_null(pc.add(found, WORD_0), OTHER).to_numpy().astype(np.int32).take(code)
            edge = np.concatenate(([0], np.cumsum(size)))
            leaf = np.full(len(code) + len(size), END_ID, np.int32)
            leaf[np.arange(len(code)) + np.repeat(rows, size)] = found
            letters = np.concatenate(([0], np.cumsum(pc.binary_length(words).to_numpy(), dtype=np.int64)))[edge]
            other = np.flatnonzero(found == OTHER)
            pair, times = np.unique(np.repeat(rows, size)[other] << 32 | code[other], return_counts=True)
            cut = pa.array(np.searchsorted(pair, np.arange(len(size) + 1) << 32).astype(np.int32))
            yield pa.RecordBatch.from_arrays([
                pa.array(rid + rows), b.column("doc_id"), b.column("held_out"), pa.array(np.diff(letters) + size + 1),
                pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(((edge + np.arange(len(edge))) * 4).astype(np.int32)), pa.py_buffer(leaf)]),
                pa.ListArray.from_arrays(cut, coded.dictionary.take(pa.array(pair & 0xFFFFFFFF))), pa.ListArray.from_arrays(cut, pa.array(times.astype(np.int32))),
            ], ["rid", "doc_id", "held_out", "n_bytes", "leaves", "tail", "tf"])
            rid += len(size)
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    return materialize(docs.select("doc_id", "text", "held_out").mapInArrow(run, LEAVES), "lm-leaves")


def texts_in(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(leaves, sizes) of some texts at a time, about LOT tokens or one text."""
    held: list[np.ndarray] = []
    size = 0
    for b in batches:
        for raw in b["leaves"]:
            held.append(np.frombuffer(raw, np.int32))
            size += len(held[-1])
            if size >= LOT:
                yield np.concatenate(held), np.array([len(x) for x in held])
                held, size = [], 0
    if held:
        yield np.concatenate(held), np.array([len(x) for x in held])


def planes(x: np.ndarray) -> bytes:
    """Whole numbers as planes of their bytes, which compress well where the numbers are small."""
    return x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def from_planes(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(8, -1).T).view("<u8").ravel()


def all_kinds(rows: DataFrame, total: int) -> DataFrame:
    """The kinds of all tokens of texts in leaves, and how often each is there: rows of many kinds (key, n) in no telling order.

    Each task's kinds are summed, then those of a bucket, so each kind is counted and learnt from once. total: of all tokens.
    """
    tasks = max(MEET_LEAST, -(-total >> MEET_BITS))
    many = np.uint64(tasks * BUCKETS)

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for leaf, size in texts_in(batches):
            key, n = tally(kinds(leaf, size))
            pair = key & ~np.uint64(((1 << OFTEN_BITS) - 1) << LEAF_BITS)  # kinds of one pair of words meet
            bucket = ((pair * _SPREAD >> np.uint64(32)) * many >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            edge = np.searchsorted(bucket[order], np.arange(int(many) + 1))
            used = np.flatnonzero(np.diff(edge)).tolist()
            parts = [order[edge[k] : edge[k + 1]] for k in used]
            for a in range(0, len(used), 500):  # few frames
                yield pd.DataFrame({"bucket": used[a : a + 500], "key": [planes(np.diff(key[x], prepend=np.uint64(0))) for x in parts[a : a + 500]], "n": [planes(n[x]) for x in parts[a : a + 500]]})

    def met(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size, limit = 0, 2 * LOT
        for b in batches:
            for key, n in zip(b["key"], b["n"], strict=True):
                held.append((np.cumsum(from_planes(key), dtype=np.uint64), from_planes(n)))
                size += len(held[-1][0])
                if size >= limit:
                    held = [tally(*map(np.concatenate, zip(*held, strict=True)))]
                    size = len(held[0][0])
                    limit = 2 * max(size, LOT)
        if held:
            key, n = tally(*map(np.concatenate, zip(*held, strict=True)))
            order = np.argsort(key * _SPREAD)
            for a in range(0, len(key), ROW):
                who = order[a : a + ROW]
                yield pd.DataFrame({"key": [planes(key[who])], "n": [planes(n[who])]})

    dealt = rows.select("leaves").mapInPandas(found, "bucket int, key binary, n binary").repartition(tasks, "bucket")
    return materialize(dealt.mapInPandas(met, "key binary, n binary"), "lm-kinds")


def kinds_in(batches: Iterator[pd.DataFrame]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(kinds, how often each is there), about LOT at a time."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for b in batches:
        for key, n in zip(b["key"], b["n"], strict=True):
            held.append((from_planes(key), from_planes(n)))
            if sum(len(x) for x, _ in held) >= LOT:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        yield tuple(map(np.concatenate, zip(*held, strict=True)))


def learn(docs: DataFrame, words: DataFrame) -> tuple[Model, np.ndarray]:
    """The model of docs (doc_id, text) and their words (token, n), and the counts of its leaves; all of a bounded size."""
    known, counts = lexicon(words)
    return fit(in_leaves(docs.withColumn("held_out", F.lit(False)), known), words, known, counts), counts


def lexicon(words: DataFrame) -> tuple[Words, np.ndarray]:
    """Head words among words (token, n), most frequent first, and the counts of all leaves."""
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    head = sorted(((r["token"].encode(), r["n"]) for r in words.where(is_head(total)).toLocalIterator()), key=lambda x: (-x[1], x[0]))  # fewer than HEAD, HEAD_BYTES each at most
    ends = words.where(F.col("token") == END).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    others = int(total) - ends - sum(n for _, n in head)
    return Words([w for w, _ in head]), np.array([others, ends, *(n for _, n in head)], np.int64)


def fit(rows: DataFrame, words: DataFrame, known: Words, counts: np.ndarray) -> Model:
    """The model of texts in leaves (see :func:`in_leaves`) and their words (token, n)."""
    spark, total = rows.sparkSession, int(counts.sum())
    bits = tuple(min(most, max(16, int(x).bit_length())) for most, x in zip(MOST_BITS, (total, PER_WORD * (len(counts) - WORD_0)), strict=True))
    tree = Tree.of(counts, min(bits))
    model = Model(known, tree, tree.bases(counts), [], first_weights(), learn_speller(words.where(~is_head(total) & (F.col("token") != END))))
    found = all_kinds(rows, total)
    fresh = spark.sparkContext.broadcast(tree)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, tables, seen = Model(None, fresh.value, None, [], None, None), [Counts(b) for b in bits], 0
        for key, n in kinds_in(batches):
            seen += int(n.sum())
            if seen >> 32:  # no slot has more
                for t in tables:
                    t.n = t.n.astype(np.uint64, copy=False)
            own.count(tables, key, n)
        for k, t in enumerate(tables):
            yield from t.frames(k)

    # a table a task: with more kinds a task, fewer tables travel
    model.tables = tables_of(found.coalesce(max(MEET_LEAST, total >> TABLE_BITS)).mapInPandas(count, "chunk int, n binary"), bits)
    shared = spark.sparkContext.broadcast(Model(None, tree, model.base, model.tables, model.weights, None))

    def weigh(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        own, bend, seen = Model(None, m.tree, m.base, m.tables, m.weights.copy(), None), start_bend(), 0
        by = [t.own_taken_out() for t in own.tables]
        for key, n in kinds_in(batches):
            own.learn(key, n, bend, by)
            seen += int(n.sum())
        yield from _weights(own.weights, seen)

    model.weights = averaged(found.mapInPandas(weigh, WEIGHTS), model.weights)
    shared.destroy()
    fresh.destroy()
    discard(found)
    return model


def spelt(words: DataFrame, speller: Speller) -> DataFrame:
    """(token, n, bits) of words (token, n): what spelling each takes, by a frozen speller."""
    shared = words.sparkSession.sparkContext.broadcast(speller)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some, n in lots(batches):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.binary()).cast(pa.string()), pa.array(n), pa.array(shared.value.bits(some))], ["token", "n", "bits"])

    return words.select("token", "n").mapInArrow(run, "token string, n long, bits double")


SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_bytes long, bits double, part double, known long"


def score_documents(rows: DataFrame, model: Model, counts: np.ndarray) -> DataFrame:
    """Per row in leaves: bits by the model without spelling, the unigram sum over head words, and how many tokens are known by these."""
    logs = np.log10(counts + 0.5)
    logs[OTHER] = 0.0
    frozen = Model(None, model.tree, model.base, model.tables, model.weights, None)
    shared = rows.sparkSession.sparkContext.broadcast((frozen, logs, counts[END_ID] > 0))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, logs, ended = shared.value
        for b in batches:
            leaves = [np.frombuffer(x, np.int32) for x in b["leaves"]]
            yield pd.DataFrame({
                "rid": b["rid"], "doc_id": b["doc_id"], "held_out": b["held_out"], "n_tokens": [len(x) for x in leaves], "n_bytes": b["n_bytes"],
                "bits": m.score_leaves(leaves), "part": [logs.take(x).sum() for x in leaves], "known": [np.count_nonzero(x != OTHER) - (not ended) for x in leaves],
            })

    return rows.select("rid", "doc_id", "held_out", "n_bytes", "leaves").mapInPandas(run, SCORED)


def op2(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Scores of all documents; see the module for the model.

    A null or empty text is the end alone; a text of any length is worked on in segments. A null doc_id has the
    remainder of the empty string. Repeated rows count and score each. Without any training row all counts are 0 and the
    first guesses score. An empty table gives an empty result; other columns are not read. Head words, fewer than HEAD by
    counting and of HEAD_BYTES at most each, are scored where the text is; all other words, each spelt once, go to their counts and bits in a join on words, none of which has
    a large share of the training tokens.
    """
    arrow_rows(spark)
    rows = training(docs)
    seen = materialize(count_tokens(rows), "lm-counts")
    words = seen.where("n > 0")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    known, counts = lexicon(words)
    rows = in_leaves(rows, known)
    model = fit(rows.where("NOT held_out"), words, known, counts)
    frozen = model.frozen()
    scored = materialize(score_documents(rows, frozen, counts), "lm-scored")
    # a word that occurs in held-out texts only may be frequent there: sums by task come first
    long = F.octet_length("token") > HEAD_BYTES  # joined by a digest; no word has a space
    short = F.when(long, F.concat(F.lit(" "), F.sha2("token", 256))).otherwise(F.col("token")).alias("token")
    tail = rows.select("rid", F.explode(F.arrays_zip(F.col("tail").alias("token"), "tf")).alias("t")).select("rid", "t.token", "t.tf").select("rid", short, "tf")
    others = spelt(seen.where(~is_head(total) & (F.col("token") != END)), frozen.speller).select(short, "n", "bits")
    counted = tail.join(others.hint("merge"), "token", "left").groupBy("rid").agg(
        F.sum(F.col("tf") * F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rest"), F.sum(F.when(F.col("n") > 0, F.col("tf")).otherwise(0)).alias("more"),
        F.sum(F.col("tf") * F.col("bits")).alias("spell"),
    )
    norm = math.log10(total + 0.5 * (distinct + 1))
    bits = F.col("scored.bits") + F.coalesce("spell", F.lit(0.0))
    return scored.alias("scored").join(counted, "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("rest", F.lit(0.0)) - F.col("n_tokens") * norm).alias("base_score"),
        (-bits * math.log10(2)).alias("score"), "n_bytes", (bits / F.col("n_bytes")).alias("bits_per_byte"),
    )
