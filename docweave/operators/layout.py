"""Tokens to lines."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions.text import center


def nest(tokens: DataFrame) -> DataFrame:
    """One row per document with its tokens in order; a document is a page, so its tokens fit into one row."""
    item = F.struct("ord", "text", "confidence", "box", "type")
    return tokens.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("items"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once: what a lambda's body only names is computed again for each element."""
    return F.transform(F.array(value), body)[0]


def fold_lines(items: Column, tolerance: float) -> Column:
    """Array of lines, each an array of items: a fold over items by height.

    An item belongs to the line whose first item is nearer than the tolerance; anchors stay where they are, so a slow
    drift begins a new line. Lines are by anchor, items of a line by x; equals keep the order of the input.
    """
    def key(i):
        cx, cy = center(i["box"])
        return F.struct(cy.alias("cy"), i["ord"].alias("ord"), cx.alias("cx"), i.alias("item"))

    def lines(ordered):
        # begins of lines first, as places in the order; then each line is a slice
        start = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("anchor"), F.expr("CAST(array() AS ARRAY<INT>)").alias("begins"))

        def step(acc, i):
            new = (F.size(acc["begins"]) == 0) | (F.abs(i["cy"] - acc["anchor"]) >= tolerance)
            n = acc["n"] + 1
            return F.when(new, F.struct(n.alias("n"), i["cy"].alias("anchor"), F.concat(acc["begins"], F.array(n)).alias("begins"))).otherwise(
                F.struct(n.alias("n"), acc["anchor"].alias("anchor"), acc["begins"].alias("begins"))
            )

        begins = F.aggregate(ordered, start, step, lambda acc: acc["begins"])
        return _bound(begins, lambda at: F.transform(at, lambda begin, k: line(F.slice(ordered, begin, F.coalesce(F.get(at, k + 1), F.size(ordered) + 1) - begin))))

    def line(mine):
        by_x = F.sort_array(F.transform(mine, lambda i: F.struct(i["cx"].alias("cx"), i["cy"].alias("cy"), i["ord"].alias("ord"), i["item"].alias("item"))))
        return F.transform(by_x, lambda i: i["item"])

    return _bound(F.sort_array(F.transform(items, key)), lines)


def line_text(items: Column) -> Column:
    """The texts of a line's items, with spaces between."""
    return F.array_join(F.transform(items, lambda i: F.coalesce(i["text"], F.lit(""))), " ")


def build_lines(nested: DataFrame, tolerance: float = 15.0) -> DataFrame:
    """(doc_id, line_no, text, items, next_items) from (doc_id, items), without a shuffle; next_items: of the line below, null for the last."""
    lines = nested.select("doc_id", fold_lines(F.col("items"), tolerance).alias("lines"))
    each = F.transform("lines", lambda row, k: F.struct(row.alias("items"), F.get("lines", k + 1).alias("next_items")))
    return lines.select("doc_id", F.posexplode(each).alias("line_no", "l")).select("doc_id", "line_no", line_text(F.col("l.items")).alias("text"), "l.items", "l.next_items")


def with_next_line(lines: DataFrame) -> DataFrame:
    """Lines with next_items; those of :func:`build_lines` have it already."""
    return lines if "next_items" in lines.columns else lines.withColumn("next_items", F.lead("items").over(Window.partitionBy("doc_id").orderBy("line_no")))


def nearest_text(x: Column, items: Column) -> Column:
    """Text of the item whose centre is nearest to x, the first of equals; null without items. Items are in line order."""
    far = F.transform(items, lambda i, k: F.struct(F.abs(center(i["box"])[0] - x).alias("far"), k.alias("k"), i["text"].alias("text")))
    return F.array_min(far)["text"]
