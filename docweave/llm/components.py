"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.common import discard, materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing changes; each round links nodes
    to the least neighbour they know, so long chains shrink by a factor each time. Each step is written to the
    shared folder, which cuts the lineage and survives lost executors. Minima are written before they are joined,
    so both sides are plain shuffles and adaptive execution can split a hub. Null ends and loops are ignored.
    """
    a, b = F.col("a"), F.col("b")
    now = materialize(edges.where(a != b).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "cc")
    seen = _sign(now)
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "cc-min")
        # large star: what is above a node goes to the least around that node
        large = materialize(
            now.join(least.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).distinct(), "cc-large"
        )
        # small star: what is below a node goes to the least below it
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-low")
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        before, now = now, materialize(small.unionByName(low.withColumnRenamed("m", "v")).distinct(), "cc")
        discard(before, least, large, low)
        if (sign := _sign(now)) == seen:
            break
        seen = sign
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _sign(df: DataFrame) -> tuple:
    return tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
