"""SimHash near-duplicates by a self-join of binary tries over the fingerprints."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, join_by_hot_key, materialize
from docweave.llm.components import connected_components

BITS = 64
#: Pairs of nodes with at most so many pairs of leaves are compared leaf by leaf.
SMALL = 256
#: Rows of one trie that a task may hold at once; larger tries are dealt into groups.
TRIE_ROWS = 50_000


def simhash(text: str | None, words: int = 4) -> int:
    """Majority of the XXH64 (seed 42) bits over all word shingles, repeats included; 0 for a text without words."""
    parts = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not parts:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        return digest(b" ".join(parts), 42)
    whole = b" ".join(parts)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    hashes = np.fromiter((digest(whole[a:b], 42) for a, b in spans), np.uint64, n)
    ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, words: int = 4) -> DataFrame:
    """(doc_id, fp) for each document; fp holds the 64 bits as a signed long."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            fp = np.array([simhash(t, words) for t in b["text"]], np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": fp})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, fp long")


def _union(comp: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the classes of i and j; comp holds the root of each leaf."""
    while True:
        a, b = comp[i], comp[j]
        if not (open_ := a != b).any():
            return
        i, j, a, b = i[open_], j[open_], a[open_], b[open_]
        np.minimum.at(comp, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := comp[comp], comp):
            comp[:] = up


def _lots(f: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """Pairs of ranges in lots with at most ``most`` pairs of leaves; a larger pair of ranges is cut."""
    while len(f):
        many = (f[:, 1] - f[:, 0]) * (f[:, 3] - f[:, 2])
        n = int(np.searchsorted(np.cumsum(many), most, side="right"))
        if n:
            yield f[:n]
            f = f[n:]
        else:
            alo, ahi, blo, bhi = f[0]
            if ahi - alo > 1:
                cut = [(alo, alo + ahi >> 1, blo, bhi), (alo + ahi >> 1, ahi, blo, bhi)]
            else:
                cut = [(alo, ahi, blo, blo + bhi >> 1), (alo, ahi, blo + bhi >> 1, bhi)]
            f = np.concatenate([np.array(cut, f.dtype), f[1:]])


def trie_links(
    x: np.ndarray, roots: np.ndarray, budget: int, depth: int, most: int = 1 << 17, front: int = BITS, more: np.ndarray | None = None, differing: int = BITS,
) -> np.ndarray:
    """Classes of leaves that chains of at most ``budget`` differing bits connect, within pairs of tries.

    x: leaves as unsigned 64-bit numbers, each trie sorted. roots: rows (a_lo, a_hi, b_lo, b_hi) of root pairs, whose
    leaves agree in the first ``depth`` bits. A node is a range of leaves with a common prefix. Pairs of nodes go
    down together; each differing bit costs one of the budget, and a pair that has spent more is pruned with all that
    lies below it. A pair whose leaves are all in one class already is pruned too; runs of leaves of one class are looked
    up anew whenever as many pairs as leaves were compared, so a dense group of near copies is not compared pair by pair.

    With ``front``, the budget is for so many first bits; with ``more``, a pair of leaves must also differ in at most
    ``differing`` bits of x and these further words together.
    """
    n = len(x)
    comp = np.arange(n)
    fore = (x >> np.uint64(BITS - front)).astype(np.uint32 if front <= 32 else np.uint64)
    zeros: dict[int, np.ndarray] = {}

    def below(d: int) -> np.ndarray:
        if d not in zeros:
            zeros[d] = np.concatenate(([0], np.cumsum(1 - ((x >> np.uint64(BITS - 1 - d)) & np.uint64(1)).astype(np.int32)))).astype(np.int32)
        return zeros[d]

    def runs() -> np.ndarray:
        """The end of the run of leaves of one class that starts at each leaf."""
        change = np.flatnonzero(np.diff(comp)) + 1
        return np.repeat(np.append(change, n), np.diff(np.concatenate(([0], change, [n]))))

    ends, joined, compared = runs(), False, 0
    stack = [(depth, roots.astype(np.int64), np.zeros(len(roots), np.int8))]
    while stack:
        d, f, spent = stack.pop()
        if len(f) > most:
            half = len(f) // 2
            stack += [(d, f[:half], spent[:half]), (d, f[half:], spent[half:])]
            continue
        if joined and compared >= n:
            ends, joined, compared = runs(), False, 0
        alo, ahi, blo, bhi = f.T
        own = (alo == blo) & (ahi == bhi)
        done = (ends[alo] >= ahi) & (ends[blo] >= bhi) & (comp[alo] == comp[blo])
        small = ~done & (((ahi - alo) * (bhi - blo) <= SMALL) | (d == BITS))
        for s in _lots(f[small], 4 * most):
            # a line is one leaf of the first node against all leaves of the second
            lines = s[:, 1] - s[:, 0]
            at = np.repeat(np.arange(len(s)), lines)
            i = np.arange(len(at)) + np.repeat(s[:, 0] - (np.cumsum(lines) - lines), lines)
            wide = (s[:, 3] - s[:, 2])[at]
            first = np.cumsum(wide) - wide
            j = np.arange(int(wide.sum()), dtype=np.int32)
            compared += len(j)
            j += np.repeat((s[at, 2] - first).astype(np.int32), wide)
            near = np.flatnonzero(np.bitwise_count(np.repeat(fore[i], wide) ^ fore[j]) <= budget)
            i, j = i[np.searchsorted(first, near, side="right") - 1], j[near]
            new = comp[i] != comp[j]
            i, j = i[new], j[new]
            if more is not None and len(i):
                total = np.bitwise_count(x[i] ^ x[j]).astype(np.int64) + np.bitwise_count(more[i] ^ more[j]).sum(axis=1, dtype=np.int64)
                i, j = i[total <= differing], j[total <= differing]
            joined |= len(i) > 0
            _union(comp, i, j)
        go = ~done & ~small
        if not go.any():
            continue
        f, spent, own = f[go], spent[go], own[go]
        alo, ahi, blo, bhi = f.T
        z = below(d)
        am, bm = alo + z[ahi] - z[alo], blo + z[bhi] - z[blo]
        cost = int(d < front)
        down = [  # (a0,b0), (a1,b1), (a0,b1), and (a1,b0) unless a is b
            (np.stack([alo, am, blo, bm], 1), spent),
            (np.stack([am, ahi, bm, bhi], 1), spent),
            (np.stack([alo, am, bm, bhi], 1), spent + cost),
            (np.stack([am, ahi, blo, bm], 1)[~own], (spent + cost)[~own]),
        ]
        f = np.concatenate([p for p, _ in down])
        spent = np.concatenate([s for _, s in down]).astype(np.int8)
        live = (spent <= budget) & (f[:, 1] > f[:, 0]) & (f[:, 3] > f[:, 2])
        if live.any():
            stack.append((d + 1, f[live], spent[live]))
    return comp


@dataclass(frozen=True)
class Turn:
    """An order of a fingerprint's bits: pieces (first bit from the high end, bits), the chosen blocks in front."""

    pieces: tuple[tuple[int, int], ...]

    def apply(self, x: F.Column, bits: int = BITS) -> F.Column:
        """The bits of a long in this order; bits: how many of the high end are the fingerprint, the others stay."""
        out, at = None, 0
        for first, size in self.pieces:
            piece = F.shiftrightunsigned(F.shiftleft(x, first), BITS - size)
            piece = F.shiftleft(piece, BITS - size - at)
            out, at = piece if out is None else out.bitwiseOR(piece), at + size
        return out if bits == BITS else out.bitwiseOR(F.shiftrightunsigned(F.shiftleft(x, bits), bits))


def turns_of(n: int, bits: int, budget: int, most: int) -> tuple[list[Turn], int]:
    """(turns, depth) for n fingerprints of so many bits: any two within the budget agree in the first ``depth`` bits of a turn.

    In budget + k blocks, two such fingerprints agree in k at least, so there is a turn for each choice of k blocks. k is
    the least that leaves about ``most`` / 2 rows below a node: turns then grow with a power of the logarithm of n, where dealing
    rows of one node into groups would repeat them in proportion to n.
    """
    for k in range(1, max(2, bits // 2 - budget)):
        cuts = [bits * b // (budget + k) for b in range(budget + k + 1)]
        blocks = list(zip(cuts, (b - a for a, b in zip(cuts, cuts[1:], strict=False)), strict=False))
        chosen = list(itertools.combinations(range(budget + k), k))
        depth = min(sum(blocks[b][1] for b in c) for c in chosen)
        if n <= most // 2 << depth or k >= bits // 2 - budget - 1 or len(chosen) > 500:
            break
    order = [[*c, *(b for b in range(budget + k) if b not in c)] for c in chosen]
    return [Turn(tuple(blocks[b] for b in o)) for o in order], depth


def few_or_merged(large: DataFrame, most: int = 100_000) -> DataFrame:
    """A table to join with: broadcast if it has few rows, else for a sort-merge join."""
    return F.broadcast(large) if large.count() <= most else large.hint("merge")


def near_links(fps: DataFrame, budget: int = 4) -> DataFrame:
    """Links (a, b) between representatives that span every class of fingerprints within ``budget`` bits.

    fps: distinct (fp, rep). The bits are turned so that any two fingerprints within the budget share the first bits of
    some turn, see :func:`turns_of`, and the trie self-join starts at the nodes below these bits, which have nothing
    spent so far; all these tries are spread over the cluster. There are as many turns as keep a node at about half of TRIE_ROWS
    rows on average; nodes that are larger all the same, as fingerprints crowd there, are dealt into groups by a hash, and
    each pair of groups is a pair of tries of its own. No link is lost. A task returns fewer links than it has leaves: a
    spanning forest, not all pairs.
    """
    spark = fps.sparkSession
    arrow_rows(spark, 10_000)
    ways, depth = turns_of(fps.count(), BITS, budget, TRIE_ROWS)
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), t.apply(F.col("fp")).alias("x")) for k, t in enumerate(ways)])
    rows = fps.select("rep", F.explode(turns).alias("t")).select(
        "rep", "t.turn", "t.x", F.shiftrightunsigned("t.x", BITS - depth).alias("node")
    )
    per_node = rows.groupBy("turn", "node").count()
    large = few_or_merged(materialize(per_node.where(F.col("count") > TRIE_ROWS), "tries"))
    rows = rows.join(large, ["turn", "node"], "left").withColumn(
        "parts", F.coalesce(F.ceil(2 * F.col("count") / TRIE_ROWS), F.lit(1)).cast("int")
    ).withColumn("own", F.pmod(F.xxhash64("x"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "turn", "node", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "x", "rep"
    )
    # order of unsigned numbers: flip the sign bit
    ordered = rows.repartition("turn", "node", "lo", "hi").sortWithinPartitions(
        "turn", "node", "lo", "hi", "own", F.col("x").bitwiseXOR(F.lit(-(1 << 63)))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held.append(b[["turn", "node", "lo", "hi", "own", "x", "rep"]].to_numpy(np.int64))
            size += len(b)
            if size >= 4 * TRIE_ROWS:
                a = np.concatenate(held)
                cut = int(np.flatnonzero((a[:, :4] != a[-1, :4]).any(axis=1))[-1]) + 1 if (a[0, :4] != a[-1, :4]).any() else 0
                if cut:  # the last trie may go on in the next batch
                    yield solve(a[:cut])
                held, size = [a[cut:]], len(a) - cut
        if size:
            yield solve(np.concatenate(held))

    def solve(a: np.ndarray) -> pd.DataFrame:
        n = len(a)
        key = np.flatnonzero((a[1:, :4] != a[:-1, :4]).any(axis=1)) + 1
        lo, hi = np.concatenate(([0], key)), np.append(key, n)
        # of a pair of two groups, the second begins where "own" is "hi"
        pair = a[lo, 2] != a[lo, 3]
        second = np.concatenate(([0], np.cumsum(a[:, 4] == a[:, 3])))
        mid = hi - (second[hi] - second[lo])
        roots = np.stack([lo, np.where(pair, mid, hi), np.where(pair, mid, lo), hi], 1)
        roots = roots[(roots[:, 1] > roots[:, 0]) & (roots[:, 3] > roots[:, 2])]
        comp = trie_links(np.ascontiguousarray(a[:, 5]).view(np.uint64), roots, budget, depth)
        far = np.flatnonzero(comp != np.arange(n))
        return pd.DataFrame({"a": a[far, 6], "b": a[comp[far], 6]})

    return ordered.mapInPandas(run, "a long, b long")


def near_groups(docs: DataFrame, words: int = 4, budget: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) for every document; component_id is the smallest doc_id reachable over links.

    Nulls: a null text counts as empty and has fingerprint zero, which links like any other. A null doc_id is
    compared by its text but never names a component while another id is there. Equal fingerprints are one
    leaf of the trie, however many rows have them. Ties, repeated rows and empty tables need no special care.
    """
    fp = materialize(fingerprints(docs, words), "fingerprints")
    # the smallest id stands for all rows with the fingerprint; rows without any id link under a negative stand-in
    reps = materialize(
        fp.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n"))
        .withColumn("rep", F.coalesce("least", F.lit(1 << 62).cast("long").bitwiseOR(F.shiftright("fp", 3).bitwiseAND(F.lit((1 << 61) - 1))))),
        "fingerprint-reps",
    )
    cc = connected_components(near_links(reps.select("fp", "rep"), budget))
    named = reps.join(cc, reps["rep"] == cc["node"], "left").select("fp", "n", F.coalesce("component", "rep").alias("component_id")).withColumn(
        "component_id", F.when(F.col("component_id") < (1 << 62), F.col("component_id"))
    )
    return join_by_hot_key(fp, materialize(named, "fingerprint-classes"), "fp", "n", fp.count()).drop("n")


def op6(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return near_groups(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
