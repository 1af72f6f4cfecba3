"""Key and value extraction from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.config import DEFAULT, EngineConfig
from docweave.functions import dictionary as d
from docweave.functions.text import after_label, center, free_date, is_valid, merge_trim, strip
from docweave.operators.layout import nearest_text, with_next_line
from docweave.operators.matching import LabelMatcher, label_like, label_like_each, match_line, matcher
from docweave.operators.mrz import mrz_fields


def valid_field_value(field: Column, value: Column, like: Column) -> Column:
    """Not empty, not a label, and of the field's form."""
    return value.isNotNull() & (strip(value) != "") & ~like & is_valid(field, value)


def _texts(items: Column) -> Column:
    return F.transform(items, lambda i: F.coalesce(i["text"], F.lit("")))


def line_values(lines: DataFrame, labels: LabelMatcher | None = None) -> DataFrame:
    """(doc_id, line_no, field, at, value, labelled): what the labels of a line yield, before the merge.

    lines: with next_items. For each label the first of these that is a valid value: text after the label in its own
    token; tokens up to the next label (unless there are more labels and a line below); nearest token of the line below;
    text after the label in the joined tokens; all the rest of a lone label's line. Else the first of the same that
    merely is no label. A line without labels is matched as a whole, and only what follows that label counts. Labels
    without any value are rows too, with a null value; ``labelled`` tells tokens that are labels from whole lines.
    """
    texts = _texts(F.col("items"))
    line_text = F.when(F.size("items") > 0, F.array_join(texts, " ")).otherwise(F.col("text"))
    seen = lines.withColumn("m", match_line(texts, line_text, labels))
    marked = F.filter(
        F.transform("m.fields", lambda f, k: F.struct(k.alias("k"), f.alias("field"), F.col("m.keywords")[k].alias("keyword"))), lambda x: x["field"].isNotNull()
    )
    seen = seen.withColumn("labels", marked).withColumn("n_labels", F.size("labels"))
    seen = seen.withColumn("whole", F.when(F.col("n_labels") == 0, line_text))
    alone = F.array(F.struct(F.lit(-1).alias("k"), F.col("m.field").alias("field"), F.col("m.keyword").alias("keyword")))
    seen = seen.withColumn("labels", F.when((F.col("n_labels") == 0) & F.col("m.field").isNotNull(), alone).otherwise(F.col("labels")))
    has_next = F.coalesce(F.size("next_items"), F.lit(0)) > 0

    own = seen.select("*", F.posexplode("labels").alias("label_no", "l"))
    k, size = F.col("l.k"), F.size("items")
    token = k >= 0
    own = own.withColumns({
        "field": F.col("l.field"), "keyword": F.col("l.keyword"), "label_text": F.when(token, F.try_element_at(texts, k + 1)).otherwise(F.col("whole")),
        "end": F.coalesce(F.try_element_at("labels", F.col("label_no") + 2)["k"], size), "has_next": has_next,
        "x": center(F.try_element_at("items", F.greatest(k + 1, F.lit(1)))["box"])[0],
    })
    slash = F.instr("label_text", "/")
    tail = strip(F.substr("label_text", slash + 1))
    raw_after = after_label(F.col("label_text"), F.col("keyword"))
    # after a slash comes the label in another language, or a value that must look like one
    after = F.when((raw_after != "") & (slash > 0), F.when((F.length(tail) < 15) & (F.instr(tail, " ") == 0), "").when(~is_valid(F.col("field"), raw_after), "").otherwise(raw_after)).otherwise(raw_after)
    only = lambda c: F.when(token, c).otherwise("")
    own = own.withColumns({
        "after": F.when(token, after).otherwise(raw_after),
        "candidate": only(strip(F.array_join(F.slice(texts, F.greatest(k, F.lit(0)) + 2, F.greatest(F.col("end") - k - 1, F.lit(0))), " "))),
        "below": only(F.coalesce(strip(nearest_text(F.col("x"), F.col("next_items"))), F.lit(""))),
        "joined": only(after_label(F.array_join(F.slice(texts, F.greatest(k, F.lit(0)) + 1, F.greatest(F.col("end") - k, F.lit(0))), " "), F.col("keyword"))),
        "rest": only(strip(F.array_join(F.slice(texts, F.lit(2), F.greatest(size - 1, F.lit(0))), " "))),
    })
    names = ("after", "candidate", "below", "joined", "rest")
    own = own.withColumn("values", F.array(*names)).withColumn("like", label_like_each(F.col("values"), labels))
    # exploding arrays of one keeps each step computed once: a filter on it is not merged into what it reads
    judged = F.zip_with("values", "like", lambda v, like: F.struct(
        v.alias("v"), ((v != "") & ~like).alias("some"), ((v != "") & ~like & is_valid(F.col("field"), v)).alias("ok")
    ))
    own = own.select("doc_id", "line_no", k.alias("at"), "field", "n_labels", "has_next", size.alias("size"), F.explode(F.array(judged)).alias("j"))
    step = lambda i, test, also=None: F.when(F.col("j")[i][test] if also is None else F.col("j")[i][test] & also, F.col("j")[i]["v"])
    after_, candidate, below, joined, rest = range(len(names))
    ways = F.array(
        step(after_, "ok"), step(candidate, "ok", ~((F.col("n_labels") > 1) & F.col("has_next"))), step(below, "ok"), step(joined, "ok"),
        step(rest, "ok", ~F.col("has_next") & (F.col("at") == 0) & (F.col("size") > 1)), step(after_, "some", F.col("at") >= 0), step(candidate, "some"), step(below, "some"),
    )
    by_label = own.select("doc_id", "line_no", "at", "field", F.explode_outer(F.slice(F.array_compact(ways), 1, 1)).alias("value"))
    # within a line the first label of a field that has any value holds its place
    here = F.when(F.col("value").isNotNull(), F.col("at"))
    return by_label.groupBy("doc_id", "line_no", "field").agg(
        F.min_by("value", here).alias("value"), F.coalesce(F.min(here), F.min("at")).alias("at"), F.max(F.col("at") >= 0).alias("labelled")
    )


def merge_fields(found: DataFrame, *more) -> DataFrame:
    """(doc_id, field, value): the first value of a field; for LONGEST fields a later one that is strictly longer.

    found: doc_id, field, value and ord, a struct or number that orders the values of a document. Null values give way
    to any other. more: further aggregates of the rows of a field.
    """
    longest = F.col("field").isin(*d.LONGEST)
    # the longest, the first of equals: the least by (-length, ord)
    rank = F.when(F.col("value").isNotNull(), F.struct(F.when(longest, -F.length("value")).otherwise(0).alias("n"), F.col("ord")))
    return found.groupBy("doc_id", "field").agg(F.min_by("value", rank).alias("value"), *more)


def extract_fields(lines: DataFrame, config: EngineConfig = DEFAULT, labels: LabelMatcher | None = None) -> DataFrame:
    """(doc_id, field, value, labelled) of all documents: the zone's values go first, then those of the lines in order.

    labelled: whether a token of the document is a label of the field; fields with a label only have a null value. labels: a
    matcher in place of the configuration's own.
    """
    labels = labels or matcher(config)
    order = lambda src: F.struct(F.lit(src).alias("src"), "line_no", "at").alias("ord")
    zone = mrz_fields(lines, config.strict).select("doc_id", "field", "value", order(0), F.lit(False).alias("labelled"))
    trimmed = F.filter(F.array(merge_trim(F.col("value"))), lambda v: ((F.length(v) >= 2) | ((F.col("field") == "sexe") & (v != ""))) & is_valid(F.col("field"), v))
    read = line_values(with_next_line(lines), labels).select("doc_id", "line_no", "at", "field", "labelled", F.explode_outer(trimmed).alias("value"))
    read = read.withColumn("value", F.when(~label_like(F.col("value"), labels), F.when(F.col("field").isin(*d.DATES), free_date(F.col("value"))).otherwise(F.col("value"))))
    return merge_fields(zone.unionByName(read.select("doc_id", "field", "value", order(1), "labelled")), F.max("labelled").alias("labelled"))


def widen(fields: DataFrame) -> DataFrame:
    """One row per document with a column for each of the ten fields, and ``seen``, the fields that have a label."""
    return fields.groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in d.FIELDS], F.collect_set(F.when(F.col("labelled"), F.col("field"))).alias("seen")
    )
