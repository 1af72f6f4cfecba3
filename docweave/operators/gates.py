"""Acceptance of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import dictionary as d

UNCLEAR, INCOMPLETE = "REJECTED_UNCLEAR_KEYS", "REJECTED_INCOMPLETE"


def quality_gate(images: DataFrame) -> DataFrame:
    """Images good enough to be read; put before recognition, so that none of it runs for the others."""
    return images.where(F.col("status").isin("ACCEPTED", "WARNING"))


def clear(c: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")) >= 2, F.lit(False))


def mandatory(columns: dict[str, Column]) -> Column:
    """Whether all mandatory fields have two characters or more."""
    out = F.lit(True)
    for name in d.MANDATORY:
        out &= clear(columns[name])
    return out


def mandatory_rows(field: Column, value: Column) -> Column:
    """The same as an aggregate of a document's rows (field, value): a flag a field is held, so no values and no wide row."""
    out = F.lit(True)
    for name in d.MANDATORY:
        out &= F.coalesce(F.bool_and(F.when(field == name, clear(value))), F.lit(False))
    return out


def labels_without_value(seen: Column, columns: dict[str, Column]) -> Column:
    """Main fields whose label was seen but that have no clear value; seen: array of fields, columns: values by field."""
    open_ = [F.when(F.array_contains(seen, f) & ~clear(columns[f]), f) for f in d.MAIN]
    return F.coalesce(F.array_compact(F.array(*open_)), F.expr("CAST(array() AS ARRAY<STRING>)"))


def n_fields(columns: dict[str, Column]) -> Column:
    return sum((columns[f].isNotNull().cast("int") for f in d.FIELDS), F.lit(0))


def outcome(columns: dict[str, Column], label_open: Column) -> tuple[Column, Column]:
    """(status, failure code). The second failure cannot occur as long as there are four mandatory fields."""
    code = F.when(~mandatory(columns) | label_open, UNCLEAR).when(n_fields(columns) < 3, INCOMPLETE)
    return F.when(code.isNull(), "SUCCESS").otherwise("FAILED"), code


def blank_failed(results: DataFrame) -> DataFrame:
    """Results in which only successes keep their fields."""
    return results.withColumns({f: F.when(F.col("status") == "SUCCESS", F.col(f)) for f in d.FIELDS if f in results.columns})


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, r"[/\\]"), -1)
