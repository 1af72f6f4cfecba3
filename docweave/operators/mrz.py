"""Machine-readable zones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import dictionary as d
from docweave.functions.text import country, mrz_date, strip, title_case

_ENTRY = "array<struct<field: string, value: string>>"


def mrz_line(text: Column) -> Column:
    """The upper-cased line if a token is part of a zone, else null."""
    line = F.upper(strip(text))
    return F.when((F.instr(line, "<") > 0) & (F.length(line) >= 15), line)


def is_name_line(line: Column) -> Column:
    double = F.instr(line, "<<") > 0
    return (
        line.rlike("^P[<A-Z][A-Z]{3}") | (line.rlike("^<[A-Z]{3}") & double) | line.rlike("^[A-Z]{3}[A-Z<]*<<") | line.rlike("^(ID[A-Z]{3}|I<[A-Z]{3})")
    )


def _entries(**values: Column) -> Column:
    parts = [F.struct(F.lit(k).alias("field"), v.alias("value")) for k, v in values.items()]
    return F.filter(F.array(*parts), lambda p: p["value"].isNotNull() & (p["value"] != ""))


def name_line(line: Column, strict: bool = False) -> Column:
    """Fields of a name line: nationality by country code, surname, given names."""
    double = F.instr(line, "<<") > 0
    cases = [(line.rlike("^P[<A-Z][A-Z]{3}"), 3, 6), (line.rlike("^<[A-Z]{3}") & double, 2, 5), (line.rlike("^[A-Z]{3}") & double, 1, 4)]
    if strict:  # document type, country, then the name
        cases.insert(0, (line.rlike("^(ID|I<)[A-Z]{3}"), 3, 6))
    code, rest = F.when(F.lit(False), F.lit(None).cast("string")), F.when(F.lit(False), line)
    for test, at, body in cases:
        code, rest = code.when(test, F.substring(line, at, 3)), rest.when(test, F.substr(line, F.lit(body)))
    rest = rest.otherwise(line)
    parts = F.split(rest, "<<", 2)
    surname = F.trim(F.replace(parts[0], F.lit("<"), F.lit(" ")))
    return _entries(
        nationalite=country(code.otherwise(None), d.COUNTRIES),
        nom=F.when(surname.rlike(r"^[A-Z\- ]{2,30}$"), surname),
        prenom=title_case(F.try_element_at(parts, F.lit(2))),
    )


TD3 = r"([A-Z0-9]{6,9})<?(?:[0-9]|<<)?([A-Z]{3})([0-9]{6})[0-9]?([MF<])([0-9]{6})"
TD1 = r"([0-9]{6})[0-9]?([MF<])([0-9]{6})"


def td3(clean: Column) -> Column:
    """Fields of a passport's data line, found anywhere in the line; empty if the pattern is not there."""
    part = lambda k: F.regexp_extract(clean, TD3, k)
    return F.when(
        clean.rlike(TD3),
        _entries(
            numero_document=part(1), nationalite=country(part(2), d.DATA_LINE_COUNTRIES), date_naissance=mrz_date(part(3), True),
            sexe=F.when(part(4).isin("M", "F"), part(4)), date_expiration=mrz_date(part(5), False),
        ),
    )


def td3_positional(clean: Column) -> Column:
    """Fields by position, for a passport line in which the pattern is not found."""
    document = F.rtrim(F.substring(clean, 1, 9), F.lit("<"))
    sex, born, until = F.substring(clean, 21, 1), F.substring(clean, 14, 6), F.substring(clean, 22, 6)
    known = sex.isin("M", "F")
    return _entries(
        numero_document=F.when(document.rlike("^[A-Z0-9]{3,9}$"), document), sexe=F.when(known, sex),
        date_naissance=F.when(known & born.rlike("^[0-9]{6}$"), mrz_date(born, True)),
        date_expiration=F.when(known & until.rlike("^[0-9]{6}$"), mrz_date(until, False)),
    )


def td1(clean: Column) -> Column:
    """Fields of a card's data line."""
    part = lambda k: F.regexp_extract(clean, TD1, k)
    hit = clean.rlike(TD1)
    return _entries(
        numero_document=F.regexp_extract(clean, "^([A-Z0-9]{6,9})", 1), date_naissance=F.when(hit, mrz_date(part(1), True)),
        date_expiration=F.when(hit, mrz_date(part(3), False)), sexe=F.when(hit & part(2).isin("M", "F"), part(2)),
    )


def parse_line(line: Column, strict: bool = False) -> Column:
    """(field, value) entries of a zone's line of any kind."""
    clean = F.replace(line, F.lit(" "), F.lit(""))
    data = F.when(F.length(clean) >= 38, F.coalesce(td3(clean), td3_positional(clean))).when(F.length(clean) >= 15, td1(clean))
    empty = F.expr(f"CAST(array() AS {_ENTRY})")
    return F.when(is_name_line(line), name_line(line, strict)).otherwise(F.coalesce(data, empty))


def mrz_fields(lines: DataFrame, strict: bool = False) -> DataFrame:
    """(doc_id, field, value, line_no, at): entries of all zone lines, in the order of the tokens."""
    items = lines.select("doc_id", "line_no", F.posexplode("items").alias("at", "i")).withColumn("mrz", mrz_line(F.col("i.text"))).where("mrz IS NOT NULL")
    return items.select("doc_id", "line_no", "at", F.explode(parse_line(F.col("mrz"), strict)).alias("e")).select("doc_id", "e.field", "e.value", "line_no", "at")
