"""Text functions on columns; built-in functions but for Unicode decomposition and the string similarities."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions import dictionary as d

#: What is stripped from a merged value, and from the text after a label.
MERGE_TRIM = " :.- /"
LABEL_TRIM = " \t\n\r :-."
#: Phrases with their letters.
PHRASES = tuple((p, frozenset(p)) for p in d.CORRECTIONS)


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def fix_common_errors(c: Column) -> Column:
    """Signs that recognition mixes up, then single spaces."""
    return F.trim(F.regexp_replace(F.translate(c, "|§€«»—_", "ISC<>--"), r"(?U)\s+", " "))


@lru_cache(maxsize=65536)
def indel_ratio(a: str, b: str) -> float:
    """100 times twice the longest common subsequence over both lengths; bit-parallel over the shorter side."""
    if not a and not b:
        return 100.0
    place: dict[str, int] = {}
    for k, c in enumerate(a):
        place[c] = place.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    open_ = full
    for c in b:
        here = open_ & place.get(c, 0)
        open_ = (open_ + here | open_ - here) & full
    return 200.0 * (len(a) - open_.bit_count()) / (len(a) + len(b))


@lru_cache(maxsize=65536)
def correct_text(text: str, above: float) -> str:
    """The most similar phrase if its score is above the threshold, the first of equals; else the text."""
    best, score = text, above
    for phrase, letters in PHRASES:
        if 200.0 * min(len(text), len(phrase)) <= score * (len(text) + len(phrase)):
            continue  # cannot reach it by length
        if 200.0 * sum(map(letters.__contains__, text)) <= score * (len(text) + len(phrase)):
            continue  # cannot reach it by the letters that the phrase has too
        if (now := indel_ratio(text, phrase)) > score:
            best, score = phrase, now
    return best


def correct_keyword(c: Column, above: float = 88.0) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else correct_text(x, above))

    return run(c)


@F.pandas_udf(T.StringType())
def _normalize(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else d.normalize(x))


def normalize_label(c: Column) -> Column:
    return _normalize(c)


def dot_split(c: Column) -> Column:
    """Dots between ASCII letters become spaces."""
    return F.regexp_replace(c, r"(?<=[a-zA-Z])\.(?=[a-zA-Z])", " ")


def label_candidates(c: Column) -> Column:
    """The whole label, then its parts between slashes of two characters or more, in order."""
    whole = dot_split(c)
    parts = F.filter(F.transform(F.split(whole, "/"), strip), lambda p: F.length(p) >= 2)
    return F.when(F.instr(whole, "/") > 0, F.concat(F.array(whole), parts)).otherwise(F.array(whole))


def after_label(text: Column, keyword: Column) -> Column:
    """What follows the raw keyword at the beginning of a text, without a colon or dash; empty if it does not begin so."""
    pattern = F.concat(F.lit(r"(?iuU)^\s*\Q"), keyword, F.lit(r"\E\s*[:\-–—]?\s*(.*)$"))
    found = F.call_function("regexp_extract", text, pattern, F.lit(1))
    bare = strip(text)
    tail = F.when(F.startswith(F.lower(bare), F.lower(keyword)), F.substr(bare, F.length(keyword) + 1)).otherwise("")
    hit = F.call_function("regexp_like", text, pattern)
    return F.when(keyword.isNull() | (keyword == ""), bare).otherwise(F.btrim(F.when(hit, found).otherwise(tail), F.lit(LABEL_TRIM)))


def merge_trim(c: Column) -> Column:
    return F.btrim(c, F.lit(MERGE_TRIM))


def mrz_date(c: Column, birth: bool) -> Column:
    """YYMMDD as DD/MM/YYYY; births after year 26 are of the last century. What is not six digits stays."""
    yy = F.substring(c, 1, 2)
    century = F.when(yy > "26", "19").otherwise("20") if birth else F.lit("20")
    return F.when(c.rlike("^[0-9]{6}$"), F.concat(F.substring(c, 5, 2), F.lit("/"), F.substring(c, 3, 2), F.lit("/"), century, yy)).otherwise(c)


def free_date(c: Column) -> Column:
    """Day, English month name and year, or just eight digits, as DD/MM/YYYY; else unchanged."""
    tight = F.regexp_replace(F.regexp_replace(F.upper(c), r"(?U)\s+", ""), r"([A-Z]{3})/\1", "$1")
    part = lambda k: F.regexp_extract(tight, r"^([0-9]{1,2})([A-Z]{3})([0-9]{4})$", k)
    month = F.try_element_at(F.create_map(*[F.lit(x) for kv in d.MONTHS.items() for x in kv]), part(2))
    digits = F.regexp_replace(c, "[^0-9]", "")
    return (
        F.when(month.isNotNull(), F.concat(F.lpad(part(1), 2, "0"), F.lit("/"), month, F.lit("/"), part(3)))
        .when(F.length(digits) == 8, F.concat(F.substring(digits, 1, 2), F.lit("/"), F.substring(digits, 3, 2), F.lit("/"), F.substring(digits, 5, 4)))
        .otherwise(c)
    )


def title_case(c: Column) -> Column:
    """Capital at the start and after anything that is no letter, else small; filler signs count as spaces."""
    bare = strip(F.regexp_replace(c, "<+", " "))
    return F.array_join(F.transform(F.split(bare, r"(?<=[^\p{L}])"), F.initcap), "")


def country(c: Column, known: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in known.items() for x in kv]), c), c)


def center(box: Column) -> tuple[Column, Column]:
    """(x, y) from three corners: the upper two for x, the first and the third for y."""
    return (box[0][0] + box[1][0]) / 2, (box[0][1] + box[2][1]) / 2


def is_valid(field: Column, value: Column) -> Column:
    """Whether a stripped value fits its field; other fields take anything. One lookup and one match, whatever the field."""
    patterns = {f: ("(?iuU)" if f in d.ANY_CASE else "(?U)") + p for f, p in d.VALIDATORS.items()}
    pattern = F.try_element_at(F.create_map(*[F.lit(x) for kv in patterns.items() for x in kv]), field)
    return F.when(pattern.isNull(), True).otherwise(F.call_function("regexp_like", strip(value), pattern))


def word_score(word: str, keyword: str) -> float:
    """Ratio of matching blocks, times 100; the order of both sides matters."""
    return SequenceMatcher(None, word, keyword).ratio() * 100
