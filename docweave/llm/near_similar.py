"""SimHash near-duplicates of a given similarity: several fingerprints a document, trie self-joins, an exact check.

One fingerprint of 64 bits within a few bits finds only very close texts: sets of word shingles with a Jaccard similarity
of 0.8 differ in 15 % of the bits. So a document has TABLES independent fingerprints of FRONT bits, each table is a
binary-trie self-join with an error budget of BUDGET, and a pair needs to be met in one table only. What the tries link
is then verified exactly on the shingles, inside each class of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows, materialize, whole_row
from docweave.llm.components import connected_components
from docweave.llm.simhash_trie import BITS, few_or_merged, trie_links, turns_of

SHINGLE_WORDS = 5
#: Two sets are near when OF * common >= LEAST * union: similarity 0.8.
LEAST, OF = 4, 5
#: Words of 64 bits in a sketch; each half of one is the fingerprint of a table.
WORDS = 16
TABLES, FRONT = 2 * WORDS, 32
#: Differing bits that a trie allows in a fingerprint. A pair of similarity 0.8 is met in a table with probability 0.26, so
#: missed in all with 5 in 10 ** 5; more similar pairs are missed less.
BUDGET = 3
#: A pair is a candidate when at most so many of 3 words of its sketches differ: expected 29, deviation 5, at similarity 0.8.
DIFFERING = 46
#: Sets of a class that a task compares at once, and their bytes; larger classes are dealt into groups, and each pair of groups is a task's.
CLASS_ROWS, CLASS_BYTES = 4096, 48 << 20
#: Rows of one trie that a task may hold at once; larger tries are dealt into groups.
TRIE_ROWS = 50_000

_SALT = np.random.default_rng(42).integers(1, 1 << 63, WORDS, np.uint64)


def shingles(text: str | None, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 of the word shingles; a shorter text is one shingle; none for a text without words."""
    parts = (text or "").encode().lower().split()  # bytes: lowers A-Z and splits at ASCII white space only
    if not parts:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(parts)
    if len(parts) <= words:
        return np.array([digest(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(parts) - words + 1
    spans = zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)
    return np.unique(np.fromiter((digest(whole[a:b], 42) for a, b in spans), np.uint64, n))


def node_of(s: np.ndarray) -> int:
    """The 63-bit name of a set; equal sets have equal names."""
    return xxhash.xxh64_intdigest(s.tobytes(), 7) >> 1


def sketch(s: np.ndarray) -> np.ndarray:
    """SimHash of WORDS * 64 bits: each word is the majority of the shingles' hashes, mixed with the word's salt."""
    ones = np.zeros(WORDS * 64, np.int64)
    for a in range(0, len(s), 255):  # sums of a byte each, so vectors of bytes
        h = s[a : a + 255, None] ^ _SALT[None, :]
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(32)
        ones += np.add.reduce(np.unpackbits(h.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)
    return np.packbits(2 * ones > len(s), bitorder="little").view(np.uint64)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, node, sketch) of each document; node names the set of its shingles."""
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "node": [node_of(s) for s in found], "sketch": [sketch(s).view(np.int64) for s in found]})

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, node long, sketch array<long>")


def candidate_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) that span every class of sets whose sketches are close in some table.

    nodes: distinct (node, sketch). In each table the bits are turned so that any two fingerprints within BUDGET share the
    first bits of some turn, see :func:`simhash_trie.turns_of`: the number of turns grows with a power of the logarithm of
    the sets, so a set has few rows at any size. The tries below these bits are spread over the cluster. Those that are above
    TRIE_ROWS all the same are dealt into groups, and each pair of groups is a pair of tries. A task returns a spanning
    forest, not all pairs.
    """
    arrow_rows(nodes.sparkSession, 10_000)
    ways, width = turns_of(nodes.count(), FRONT, BUDGET, TRIE_ROWS)
    # odd tables have the lower half of their word in front
    words = nodes.select("node", "sketch", F.explode(F.sequence(F.lit(0), F.lit(TABLES - 1))).alias("table")).selectExpr(
        "node", "table", *[f"sketch[CAST((table DIV 2 + {k}) % {WORDS} AS INT)] AS {c}" for k, c in enumerate("xyz")],
    ).selectExpr("node", "table", "y", "z", f"IF(table % 2 = 1, shiftleft(x, {FRONT}) | shiftrightunsigned(x, {FRONT}), x) AS x")
    turned = F.array(*[F.struct(F.lit(k).alias("k"), t.apply(F.col("x"), FRONT).alias("x")) for k, t in enumerate(ways)])
    rows = words.select("node", "table", "y", "z", F.explode(turned).alias("t")).select(
        "node", (F.col("table") * len(ways) + F.col("t.k")).alias("trie"), "y", "z", "t.x", F.shiftrightunsigned("t.x", BITS - width).alias("root")
    )
    per_trie = rows.groupBy("trie", "root").count()
    large = few_or_merged(materialize(per_trie.where(F.col("count") > TRIE_ROWS), "tries"))
    rows = rows.join(large, ["trie", "root"], "left").withColumn(
        "parts", F.coalesce(F.ceil(2 * F.col("count") / TRIE_ROWS), F.lit(1)).cast("int")
    ).withColumn("own", F.pmod(F.xxhash64("x"), "parts").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "trie", "root", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "x", "y", "z", "node"
    )
    ordered = rows.repartition("trie", "root", "lo", "hi").sortWithinPartitions(
        "trie", "root", "lo", "hi", "own", F.col("x").bitwiseXOR(F.lit(-(1 << 63)))  # order of unsigned numbers
    )
    names = ["trie", "root", "lo", "hi", "own", "x", "y", "z", "node"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[np.ndarray] = []
        size = 0
        for b in batches:
            held.append(b[names].to_numpy(np.int64))
            size += len(b)
            if size >= 2 * TRIE_ROWS:
                a = np.concatenate(held)
                other = np.flatnonzero((a[:, :4] != a[-1, :4]).any(axis=1))
                if len(other):  # the last trie may go on in the next batch
                    yield solve(a[: other[-1] + 1])
                    a = a[other[-1] + 1 :]
                held, size = [a], len(a)
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
        x, more = np.ascontiguousarray(a[:, 5]).view(np.uint64), np.ascontiguousarray(a[:, 6:8]).view(np.uint64)
        comp = trie_links(x, roots, BUDGET, width, front=FRONT, more=more, differing=DIFFERING)
        # to the least set of the class, so that tries which hold the same class give the same links
        least = a[:, 8].copy()
        np.minimum.at(least, comp, a[:, 8])
        least = least[comp]
        far = np.flatnonzero(a[:, 8] != least)
        links = np.unique(np.stack([a[far, 8], least[far]], 1), axis=0)
        return pd.DataFrame({"a": links[:, 0], "b": links[:, 1]})

    return ordered.mapInPandas(run, "a long, b long").distinct()


def is_near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the similarity asked for."""
    if OF * min(len(a), len(b)) < LEAST * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return OF * common >= LEAST * (len(a) + len(b) - common)


def spanning_links(sets: list[np.ndarray], second: int = 0, joined: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between near sets that span every class of them; with ``second``, only links from sets before it to others.

    joined: sets that are known to be in one class; of the sets before ``second`` and of those behind it, these are the
    last, so that they are never compared with one another.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets])
    start = np.cumsum(size) - size
    vocabulary, flat = np.unique(np.concatenate(sets), return_inverse=True)
    comp, mark, out = np.arange(n), np.zeros(len(vocabulary), bool), []
    known = np.zeros(n, bool) if joined is None else joined
    if known.any():
        comp[known] = np.flatnonzero(known)[0]
    for i in range(second or n - 1):
        a = second or i + 1
        b = a + int((~known[a:]).sum()) if known[i] else n
        if (comp[a:b] == comp[i]).all():
            continue
        own = flat[start[i] : start[i] + size[i]]
        mark[own] = True
        upto = start[b] if b < n else len(flat)
        common = np.add.reduceat(mark[flat[start[a] : upto]], start[a:b] - start[a], dtype=np.int64)
        mark[own] = False
        near = a + np.flatnonzero(OF * common >= LEAST * (size[i] + size[a:b] - common))
        near = near[comp[near] != comp[i]]
        if len(near):
            met, first = np.unique(comp[near], return_index=True)
            out += [(i, int(j)) for j in near[first]]
            comp[np.isin(comp, met)] = comp[i]
    return out


def star_links(held: DataFrame) -> DataFrame:
    """Links (a, b) from the first set of each class to all sets near it.

    held: component, parts, own, node, set. A class is dealt into its groups, each of which begins with the class's first set
    and is streamed, so nothing but that set stays in memory; dense classes, as copies make them, need no other comparison.
    """
    first = held.groupBy("component").agg(F.min("node").alias("node"))
    heads = held.join(first.hint("merge"), ["component", "node"], "left_semi").withColumn("own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    rows = heads.select("component", "own", F.lit(0).alias("at"), "node", "set").unionByName(held.select("component", "own", F.lit(1).alias("at"), "node", "set"))
    ordered = rows.repartition("component", "own").sortWithinPartitions("component", "own", "at")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head, kept = (0, 0), np.zeros(0, np.uint64)
        for b in batches:
            out = []
            for at, node, raw in b[["at", "node", "set"]].itertuples(index=False):
                s = np.frombuffer(raw, np.uint64)
                if at == 0:
                    head, kept = node, s
                elif node != head and is_near(kept, s):
                    out.append((head, node))
            yield pd.DataFrame(out, columns=["a", "b"], dtype=np.int64)

    return ordered.mapInPandas(run, "a long, b long")


def verified_links(docs: DataFrame, nodes: DataFrame, candidates: DataFrame) -> DataFrame:
    """Links (a, b) between sets of similarity 0.8 or more that span every class of them within a candidate class.

    nodes: (node, least), where least is an id of a document with the set; candidates: (node, component). Only sets of
    candidate classes are built again, each once. First all sets of a class are compared with one of them, see
    :func:`star_links`. Where that leaves some out, a task compares those with all others, in memory, or for a large class two
    groups of it, and returns a spanning forest. Groups are bounded by rows and by bytes; a longer set is a group of its own.
    """
    wanted = nodes.join(candidates.select("node").hint("merge"), "node", "left_semi").select("node", "least")
    ids = wanted.select(F.col("least").alias("__id")).distinct()
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.join(ids.hint("merge"), texts["doc_id"].eqNullSafe(F.col("__id")), "left_semi").select("text")

    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [shingles(t) for t in b["text"]]
            yield pd.DataFrame({"node": [node_of(s) for s in found], "set": [s.tobytes() for s in found]})

    arrow_rows(docs.sparkSession)
    built = texts.mapInPandas(build, "node long, set binary")
    sets = materialize(built.join(wanted.select("node").hint("merge"), "node", "left_semi").dropDuplicates(["node"]), "near-sets")
    members = materialize(candidates.join(sets.select("node", F.octet_length("set").alias("bytes")).hint("merge"), "node"), "near-members")
    sized = members.groupBy("component").agg(F.count(F.lit(1)).alias("m"), F.sum("bytes").alias("bytes")).where("m > 1").select(
        "component", F.greatest(F.ceil(F.col("m") / CLASS_ROWS), F.ceil(F.col("bytes") / CLASS_BYTES)).cast("int").alias("parts")
    )
    place = members.select("node", "component").join(sized.hint("merge"), "component").withColumn("own", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    place = materialize(place, "near-places")
    stars = materialize(star_links(place.join(sets.hint("merge"), "node")), "near-stars")
    marked = place.join(stars.select(F.col("b").alias("node"), F.lit(True).alias("star")).hint("merge"), "node", "left").join(
        place.groupBy("component").agg(F.min("node").alias("head")).hint("merge"), "component"
    ).withColumn("star", F.coalesce("star", F.col("node") == F.col("head")))
    marked = materialize(marked.drop("head"), "near-marked")
    open_ = marked.where("NOT star").select("component").distinct()
    rows = marked.join(open_.hint("merge"), "component", "left_semi").join(sets.hint("merge"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "component", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "star", "node", "set"
    )
    ordered = rows.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi", "own", "star", "node")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held = None, []

        def solve() -> pd.DataFrame:
            second = sum(own == key[1] for own, *_ in held) if key[1] != key[2] else 0
            star = np.array([s for _, s, _, _ in held])
            links = spanning_links([s for *_, s in held], second, star) if second < len(held) and len(held) > 1 else []
            return pd.DataFrame({"a": [held[i][2] for i, _ in links], "b": [held[j][2] for _, j in links]}, dtype=np.int64)

        for b in batches:
            done = []
            for component, lo, hi, own, star, node, raw in b[["component", "lo", "hi", "own", "star", "node", "set"]].itertuples(index=False):
                if key != (component, lo, hi):
                    if held:
                        done.append(solve())
                    key, held = (component, lo, hi), []
                held.append((own, star, node, np.frombuffer(raw, np.uint64)))
            if done:
                yield pd.concat(done)
        if held:
            yield solve()

    return stars.unionByName(ordered.mapInPandas(run, "a long, b long").distinct())


def near_classes(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, node) of all documents, and (node, name) of all sets: name is the least node of the set's class."""
    marked = materialize(sketches(docs), "near-sketches")
    nodes = materialize(marked.groupBy("node").agg(F.min("doc_id").alias("least"), F.first("sketch").alias("sketch")), "near-nodes")
    candidates = connected_components(candidate_links(nodes.where("size(sketch) > 0").select("node", "sketch")))
    classes = connected_components(verified_links(docs, nodes.select("node", "least"), candidates))
    return marked.select("doc_id", "node"), nodes.select("node", "least").join(classes.hint("merge"), "node", "left").select(
        "node", "least", F.coalesce("component", "node").alias("name")
    )


def drop_near(docs: DataFrame) -> DataFrame:
    """One document of each class stays, the one with the smallest doc_id, whole and with all its columns.

    Classes are chains of pairs whose sets of SHINGLE_WORDS-word shingles have a Jaccard similarity of 0.8 or more. Nulls: a
    null text counts as empty and is near to empty ones only; a null doc_id stays only if no other row has the class.
    Rows are named by id and set together, so rows with one id and different texts are each judged by their own text;
    of rows that repeat both, one stays. An empty table gives an empty result.
    """
    marked, named = near_classes(docs)
    # a class is held by its row with the smallest id; of several sets with that id, by the least
    keep = materialize(named.groupBy("name").agg(
        F.min(F.struct(F.col("least").isNull().alias("z"), "least", "node")).alias("k")
    ).select(F.col("k.least").alias("__keep"), F.col("k.node").alias("__node")), "near-keep")
    ids = keep.select("__keep").distinct()
    rows = docs.select(whole_row(docs), F.col("doc_id").alias("__id"), F.coalesce("text", F.lit("")).alias("__text"))
    rows = rows.join(ids.hint("merge"), F.col("__id").eqNullSafe(F.col("__keep")), "left_semi")
    # ids with more than one row among those left are looked at by their sets
    plain = marked.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__again"))
    again = materialize(plain.join(ids.hint("merge"), F.col("__again").eqNullSafe(F.col("__keep")), "left_semi"), "near-again")
    if again.isEmpty():
        return rows.select("__row.*")
    once = rows.join(again.hint("merge"), F.col("__id").eqNullSafe(F.col("__again")), "left_anti").select("__row")

    @F.pandas_udf("long")
    def node(text: pd.Series) -> pd.Series:
        return pd.Series([node_of(shingles(t)) for t in text], dtype="int64")

    arrow_rows(docs.sparkSession)
    twice = rows.join(again.hint("merge"), F.col("__id").eqNullSafe(F.col("__again")), "left_semi").withColumn("__set", node("__text"))
    twice = twice.join(keep.hint("merge"), F.col("__id").eqNullSafe(F.col("__keep")) & (F.col("__set") == F.col("__node")), "left_semi")
    return once.unionByName(twice.dropDuplicates(["__id", "__set"]).select("__row")).select("__row.*")
