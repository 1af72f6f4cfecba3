"""Packing token ids into rows of fixed length: best-fit-decreasing with a segment tree over open capacity."""

from __future__ import annotations

import base64
import functools
import heapq
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows

#: Pre-split of the byte-level vocabulary (a fixed value: the public pattern, in its form without backtracking).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Ends every document and fills what a row has left.
END_ID = 50256
ROW_TOKENS = 2048
#: Tokens that a task holds before it packs them; bounds memory and how far a row's documents lie apart.
SHARD_TOKENS = 8 << 20


@functools.lru_cache(maxsize=2)
def _encoder(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def byte_bpe(path: str = VOCABULARY) -> Callable[[str], np.ndarray]:
    """Token ids of a text; special strings in it are ordinary text. The file must be on every executor."""
    return lambda text: _encoder(path).encode_to_numpy(text)


class CapacityTree:
    """Which capacities 0..n some open row has left, in a segment tree of counts; finds the least one that fits."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.count = [0] * (2 * self.size)

    def add(self, capacity: int, by: int) -> None:
        k = capacity + self.size
        while k:
            self.count[k] += by
            k >>= 1

    def least(self, need: int) -> int:
        """The least capacity of an open row that is at least ``need``; -1 if there is none."""
        k, count = need + self.size, self.count
        if not count[k]:
            # up until a right neighbour has something, then down to its leftmost
            while k > 1 and (k & 1 or not count[k + 1]):
                k >>= 1
            if k <= 1:
                return -1
            k += 1
            while k < self.size:
                k = 2 * k if count[2 * k] else 2 * k + 1
        return k - self.size


def best_fit_decreasing(lengths: list[int], capacity: int) -> list[list[int]]:
    """Rows of item numbers; each item goes to the row it leaves least room in. Ties: earlier item, earliest such row."""
    tree, rows = CapacityTree(capacity), []
    by_room: dict[int, list[int]] = {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        need = lengths[i]
        room = tree.least(need)
        if room < 0:
            rows.append([i])
            k, room = len(rows) - 1, capacity
        else:
            k = heapq.heappop(by_room[room])
            tree.add(room, -1)
            rows[k].append(i)
        if room > need:
            heapq.heappush(by_room.setdefault(room - need, []), k)
            tree.add(room - need, 1)
    return rows


def pack_shard(docs: list[tuple[int | None, np.ndarray]], row_tokens: int, end_id: int) -> Iterator[dict]:
    """Rows of one shard. A document longer than a row is cut into pieces that carry their offset; nothing is lost."""
    pieces = [(d, a, ids[a : a + row_tokens]) for d, ids in docs for a in range(0, len(ids), row_tokens)]
    for row in best_fit_decreasing([len(p[2]) for p in pieces], row_tokens):
        parts = [pieces[i] for i in row]
        ends = np.cumsum([len(p[2]) for p in parts])
        ids = np.full(row_tokens, end_id, np.uint32 if end_id > 65535 else np.uint16)
        ids[: ends[-1]] = np.concatenate([p[2] for p in parts])
        yield {
            "ids": ids.tobytes(), "cu_seqlens": [0, *ends.tolist()], "resets": [0, *ends[:-1].tolist()],
            "doc_ids": [p[0] for p in parts], "doc_offsets": [p[1] for p in parts],
        }


PACKED = (
    "shard string, row int, ids binary, cu_seqlens array<int>, resets array<int>, doc_ids array<long>, doc_offsets array<int>"
)


def pack(docs: DataFrame, tokenize: Callable[[str], np.ndarray], row_tokens: int = ROW_TOKENS, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pack (doc_id, text) into an id matrix: one row of the result is one row of ``row_tokens`` ids.

    ids: little-endian unsigned numbers of 2 bytes (4 if ids need it); a shard's rows in order are its matrix. Segment
    k of a row is ids[cu_seqlens[k] : cu_seqlens[k + 1]], belongs to doc_ids[k] and begins at its token
    doc_offsets[k]; positions count from 0 again at each of ``resets``. What follows the last segment is filling.
    Each document ends with ``end_id``, so null and empty texts are one token. Shards are made of the rows a task
    reads, up to ``shard_tokens`` and a document more, so packing needs no shuffle, and a task's memory is bounded.
    Repeated rows are packed each; a null doc_id stays null. The order of rows is that of the scan.
    """
    arrow_rows(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, shard, held, size = TaskContext.get().partitionId(), 0, [], 0

        def flush() -> Iterator[pd.DataFrame]:
            rows = list(pack_shard(held, row_tokens, end_id))
            for a in range(0, len(rows), 1024):
                out = pd.DataFrame(rows[a : a + 1024])
                out.insert(0, "row", np.arange(a, a + len(out)))
                out.insert(0, "shard", f"{part:06d}-{shard:04d}")
                yield out

        kind = np.uint32 if end_id > 65535 else np.uint16
        for b in batches:
            for d, text in zip(b["doc_id"].astype(object), b["text"], strict=True):
                ids = np.append(tokenize(text).astype(kind), kind(end_id))
                held.append((None if d is None or d != d else int(d), ids))
                size += len(ids)
                if size >= shard_tokens:
                    yield from flush()
                    shard, held, size = shard + 1, [], 0
        if held:
            yield from flush()

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, PACKED)


def write_packed(packed: DataFrame, path: str) -> None:
    """Write the matrices; a shard's rows stay together and in order, as the tasks make them."""
    packed.write.parquet(path)


def op8(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return pack(docs, byte_bpe())
