"""The engine's functions for SQL: scalar functions, and table functions for LATERAL joins.

    register(spark)
    spark.sql("SELECT d.doc_id, z.* FROM documents d, LATERAL docweave_lines(d.items) l, LATERAL explode(l.items) i, LATERAL docweave_zones(i.col.text) z")

Nearly all are SQL functions made from the same expressions that the engine uses, so they run in the plan without Python;
normalising, correcting and matching are Arrow functions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave import schemas
from docweave.config import DEFAULT, EngineConfig
from docweave.functions import text as t
from docweave.operators import layout, mrz
from docweave.operators.matching import LabelMatcher, looks_like, match_function, matcher

_OPERATOR = re.compile(r"(?<![\w`)\]>])(<=>|<=|>=|!=|[-+*/%<>=!]|and|or|not|in|rlike)\(")


def sql_text(column: Column) -> str:
    """A column's expression as SQL text. Its printed form calls operators like functions, which is SQL once their names are quoted."""
    parts = re.split(r"('(?:[^'\\]|\\.|'')*')", column._jc.node().sql())
    return "".join(p if k % 2 else _OPERATOR.sub(r"`\1`(", p) for k, p in enumerate(parts))


def _scalars() -> dict[str, tuple[str, str, Column]]:
    """name: parameters, type, body."""
    text, keyword, field, value = F.col("text"), F.col("keyword"), F.col("field"), F.col("value")
    return {
        "fix_errors": ("text STRING", "STRING", t.fix_common_errors(text)),
        "after_label": ("text STRING, keyword STRING", "STRING", t.after_label(text, keyword)),
        "trim_value": ("value STRING", "STRING", t.merge_trim(value)),
        "birth_date": ("text STRING", "STRING", t.mrz_date(text, True)),
        "expiry_date": ("text STRING", "STRING", t.mrz_date(text, False)),
        "free_date": ("text STRING", "STRING", t.free_date(text)),
        "title_case": ("text STRING", "STRING", t.title_case(text)),
        "is_valid": ("field STRING, value STRING", "BOOLEAN", t.is_valid(field, value)),
        "label_parts": ("text STRING", "ARRAY<STRING>", t.label_candidates(text)),
        "zone_line": ("text STRING", "STRING", mrz.mrz_line(text)),
    }


def register(spark: SparkSession, config: EngineConfig = DEFAULT, labels: LabelMatcher | None = None, prefix: str = "docweave_") -> list[str]:
    """Make the functions known to a session, and return their names. labels: a matcher in place of the configuration's own.

    Scalars: fix_errors, after_label, trim_value, birth_date, expiry_date, free_date, title_case, is_valid, label_parts,
    zone_line, normalize, correct, match (a struct of field and keyword), label_like. Tables: lines(items) with line_no,
    text and items, in the order of the page; zones(text) with field and value. Null in, null or no rows out.
    """
    names = []

    def sql(name: str, rest: str) -> None:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}{rest}")
        names.append(prefix + name)

    for name, (given, kind, body) in _scalars().items():
        sql(name, f"({given}) RETURNS {kind} RETURN {sql_text(body)}")
    fold = sql_text(layout.fold_lines(F.col("tokens"), config.line_tolerance))
    items = f"ARRAY<{schemas.TOKEN_STRUCT}>"
    said = sql_text(layout.line_text(F.col("row")))
    sql("lines", f"(tokens {items}) RETURNS TABLE(line_no INT, text STRING, items {items}) RETURN SELECT p.at, {said}, p.row FROM posexplode({fold}) AS p(at, row)")
    entries = sql_text(mrz.parse_line(mrz.mrz_line(F.col("line")), config.strict))
    sql("zones", f"(line STRING) RETURNS TABLE(field STRING, value STRING) RETURN SELECT e.entry.field, e.entry.value FROM explode({entries}) AS e(entry)")

    labels = labels or matcher(config)

    def by_row(kind: T.DataType, rule):
        return F.pandas_udf(lambda s: s.map(rule), kind)

    python = {
        "normalize": t._normalize, "correct": by_row(T.StringType(), lambda x: None if x is None else t.correct_text(x, config.correction_score)),
        "label_like": by_row(T.BooleanType(), lambda x: looks_like(labels, x)), "match": match_function(labels),
    }
    for name, function in python.items():
        spark.udf.register(prefix + name, function)
        names.append(prefix + name)
    return names

