"""Connected parts of pages that are larger than a task should hold: by tiles, merged where tiles meet."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.operators import kernels
from docweave.sources.shared import discard, written

#: A part within its tile: where the tile begins, and the part's number there.
_PART = "struct<y0: int, x0: int, k: int>"


def tile_parts(tiles: DataFrame, corners: bool = True) -> DataFrame:
    """(id, part, x, y, x2, y2, area, ring) of tiles (id, y0, x0, height, width, mask): the parts inside each tile.

    mask: a byte a pixel, row by row, 0 or else ink. Boxes are in the page's pixels, x2 and y2 included; ring: the part's pixels on the tile's edge, which alone
    can touch other tiles.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for t in b.itertuples(index=False):
                mask = np.frombuffer(t.mask, np.uint8).reshape(t.height, t.width) != 0
                labels, n = kernels.components(mask, corners)
                if not n:
                    continue
                edge = np.zeros_like(mask)
                edge[[0, -1]] = edge[:, [0, -1]] = True
                y, x = np.nonzero(edge & mask)
                order = np.argsort(labels[y, x], kind="stable")
                y, x, at = y[order] + t.y0, x[order] + t.x0, np.searchsorted(labels[y, x][order], np.arange(1, n + 2))
                for k, (bx, by, bw, bh, area) in enumerate(kernels.boxes(labels, n).tolist()):
                    ring = [{"y": int(v), "x": int(u)} for v, u in zip(y[at[k] : at[k + 1]], x[at[k] : at[k + 1]], strict=True)]
                    out.append((t.id, {"y0": t.y0, "x0": t.x0, "k": k}, bx + t.x0, by + t.y0, bx + bw - 1 + t.x0, by + bh - 1 + t.y0, area, ring))
            yield pd.DataFrame(out, columns=["id", "part", "x", "y", "x2", "y2", "area", "ring"])

    kind = tiles.schema["id"].dataType.simpleString()
    schema = f"id {kind}, part {_PART}, x int, y int, x2 int, y2 int, area long, ring array<struct<y: int, x: int>>"
    return tiles.select("id", "y0", "x0", "height", "width", "mask").mapInPandas(run, schema)


def touching(parts: DataFrame, corners: bool = True) -> DataFrame:
    """(id, a, b): parts of different tiles that have pixels side by side (or at a corner)."""
    rim = parts.select("id", "part", F.explode("ring").alias("p")).select("id", "part", "p.y", "p.x")
    steps = [(0, 1), (1, 0), *(((1, 1), (1, -1)) if corners else ())]  # the other half is found from the other side
    beside = F.explode(F.array(*[F.struct((F.col("y") + dy).alias("y"), (F.col("x") + dx).alias("x")) for dy, dx in steps])).alias("q")
    ahead = rim.select("id", F.col("part").alias("a"), beside).select("id", "a", F.col("q.y").alias("y"), F.col("q.x").alias("x"))
    met = ahead.join(rim.withColumnRenamed("part", "b").hint("merge"), ["id", "y", "x"])
    return met.where((F.col("a.y0") != F.col("b.y0")) | (F.col("a.x0") != F.col("b.x0"))).select("id", "a", "b").distinct()


def roots(parts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, part, root): the least part of each class of linked parts, by rounds of least neighbours and shortened ways.

    Joins are by exchange even where a side is small: broadcasts of all rounds would go through the driver. Each round is written, so its lineage is short and it outlives any executor; rounds grow with the logarithm of how
    many tiles a part goes through. Parts without links are left out: they are their own root.
    """
    spark = parts.sparkSession
    both = written(links.unionByName(links.select("id", F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    now = written(both.groupBy("id", F.col("a").alias("part")).agg(F.least(F.min("b"), F.first("a")).alias("root")), "roots")
    while True:
        near = both.join(now.select("id", F.col("part").alias("b"), F.col("root").alias("theirs")).hint("merge"), ["id", "b"]).groupBy("id", F.col("a").alias("part")).agg(F.min("theirs").alias("theirs"))
        least = now.join(near.hint("merge"), ["id", "part"]).select("id", "part", "root", F.least("root", "theirs").alias("next"))
        jump = now.select("id", F.col("part").alias("next"), F.col("root").alias("far"))
        after = written(least.join(jump.hint("merge"), ["id", "next"], "left").select("id", "part", F.least("next", F.coalesce("far", "next")).alias("root"), (F.least("next", F.coalesce("far", "next")) != F.col("root")).alias("moved")), "roots")
        discard(spark, now.written_to)
        now = after
        if now.where("moved").isEmpty():
            discard(spark, both.written_to)
            return now.select("id", "part", "root")


def regions(tiles: DataFrame, corners: bool = True) -> DataFrame:
    """(id, x, y, width, height, area): the connected parts of pages given as tiles, a row each.

    A page of any size is one result: tiles are labelled each by itself, parts that touch across tiles are linked by a join on
    pixels of the tiles' edges, and boxes and areas are summed by class. Pages without ink have no row. A page's tiles must
    not overlap; tiles that are missing count as empty.
    """
    parts = written(tile_parts(tiles, corners), "parts")
    known = roots(parts, touching(parts, corners))
    rows = parts.join(known.hint("merge"), ["id", "part"], "left").withColumn("root", F.coalesce("root", "part"))
    boxes = rows.groupBy("id", "root").agg(F.min("x").alias("x"), F.min("y").alias("y"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.sum("area").alias("area"))
    return boxes.select("id", "x", "y", (F.col("x2") - F.col("x") + 1).alias("width"), (F.col("y2") - F.col("y") + 1).alias("height"), "area")


def char_heights(tiles: DataFrame, whole: int) -> DataFrame:
    """(id, char_height): median height of the parts that look like characters, over pages of ``whole`` pixels, see ``kernels.median_height``."""
    @F.pandas_udf("double")
    def height(parts: pd.Series) -> pd.Series:
        return parts.map(lambda rows: kernels.median_height(*np.array([[r["width"], r["height"], r["area"]] for r in rows]).T, whole))

    box = F.struct("y", "x", "width", "height", "area")
    kept = regions(tiles).groupBy("id").agg(F.array_sort(F.collect_list(box)).alias("parts"))
    return kept.select("id", height("parts").alias("char_height"))
