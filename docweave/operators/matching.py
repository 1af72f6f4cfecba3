"""Matching of recognised text to field labels."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Mapping
from functools import lru_cache
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docweave.config import DEFAULT, EngineConfig
from docweave.functions import dictionary as d
from docweave.functions.text import label_candidates, normalize_label, word_score

Label = tuple[str | None, str | None]


class LabelMatcher(Protocol):
    """What extraction asks of a matcher; any picklable object with this method can take the place of :class:`Matcher`."""

    def match(self, text: str | None) -> Label: ...


def _letters(word: str) -> np.ndarray:
    """How often a word has each letter; other signs than a-z and 0-9 share buckets, which only raises the bound."""
    return np.bincount([ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 32 for c in word], minlength=58)[:58]


@lru_cache(maxsize=1 << 18)
def _score(word: str, keyword_word: str) -> float:
    return word_score(word, keyword_word)


class Matcher:
    """Labels of a dictionary: exact, by their words, or similar; thresholds for labels of one word and of several.

    Equal matchers are one object in a worker, so that what they remember outlives a task.
    """

    def __init__(self, keywords: tuple[tuple[str, tuple[str, ...]], ...], single: float, several: float):
        self.keywords, self.single, self.several = keywords, single, several
        self.entries = [(f, k, d.normalize(k), tuple(d.normalize(k).split())) for f, ks in keywords for k in ks]
        self.exact: dict[str, tuple[str, str]] = {}
        for f, k, n, _ in self.entries:
            self.exact.setdefault(n, (f, k))
        words = sorted({w for *_, ws in self.entries for w in ws})
        at = {w: k for k, w in enumerate(words)}
        self.word_set = frozenset(words)
        self.counts = np.stack([_letters(w) for w in words]) if words else np.zeros((0, 58), np.int64)
        self.lengths = np.array([len(w) for w in words])
        #: Rows of keywords, columns of their words: the mean over a keyword's words.
        self.mean = np.zeros((len(self.entries), len(words)))
        for i, (*_, ws) in enumerate(self.entries):
            for w in ws:
                self.mean[i, at[w]] += 1.0 / len(ws)
        self.least = np.array([single if len(ws) == 1 else several for *_, ws in self.entries])
        self.bounds = lru_cache(maxsize=1 << 16)(self._bounds)
        self.match = lru_cache(maxsize=1 << 17)(self._match)
        self.looks_like_label = lru_cache(maxsize=1 << 17)(lambda value: looks_like(self, value))
        self.known: dict[str | None, Label] = {}

    def __reduce__(self):
        return matcher_of, (self.keywords, self.single, self.several)

    def _bounds(self, word: str) -> np.ndarray:
        """No ratio is above twice the letters that both words have, in any order, over both lengths; for all keyword words."""
        return 200.0 * np.minimum(self.counts, _letters(word)).sum(axis=1) / (self.lengths + len(word))

    def fuzzy(self, have: tuple[str, ...], top: float) -> tuple[float, tuple[str, str] | None]:
        """Best (score, label) above ``top`` by the mean over a keyword's words of the best ratio with any word."""
        bound = self.mean @ np.max([self.bounds(h) for h in have], axis=0)
        best = None
        for i in np.flatnonzero(bound >= self.least - 1e-6).tolist():
            field, keyword, _, words = self.entries[i]
            if bound[i] > top - 1e-6:
                score = sum(max(_score(h, w) for h in have) for w in words) / len(words)
                if score >= self.least[i] and score > top:
                    top, best = score, (field, keyword)
        return top, best

    def _norms(self, text: str | None) -> list[str]:
        """A text's candidate labels in normal form, in order; those without any letter are left out."""
        if not text:
            return []
        clean = re.sub(r"(?<=[a-zA-Z])\.(?=[a-zA-Z])", " ", text)
        candidates = [clean, *(p for p in map(str.strip, clean.split("/")) if len(p) >= 2)] if "/" in clean else [clean]
        return [n for n in map(d.normalize, candidates) if n]

    def _sure(self, norms: list[str]) -> Label | None:
        """The exact or word-subset label of the earliest candidate that has one."""
        for norm in norms:
            if norm in self.exact:
                return self.exact[norm]
            inside = self.word_set.intersection(norm.split())
            if inside:
                for field, keyword, _, words in self.entries:
                    if inside.issuperset(words):
                        return field, keyword
        return None

    def _match(self, text: str | None) -> Label:
        """(field, keyword) of a text: for each candidate an exact or a word-subset label, else the best fuzzy one of all.

        An exact or subset hit of an earlier candidate goes before anything of a later one; of fuzzy hits, the highest
        score, the earliest of equals.
        """
        norms = self._norms(text)
        if sure := self._sure(norms):
            return sure
        best: Label = (None, None)
        top = 0.0
        for norm in norms:
            top, found = self.fuzzy(tuple(norm.split()), top)
            best = found or best
        return best

    def match_all(self, texts: Iterable[str | None]) -> dict[str | None, Label]:
        """The same as :meth:`match` for each of the texts; those without a sure hit are compared with the keywords together."""
        found: dict[str | None, Label] = {}
        rest = []
        for text in dict.fromkeys(texts):
            if (label := self.known.get(text)) is None:
                norms = self._norms(text)
                label = self._sure(norms) or (None if norms else (None, None))
            if label is None:
                rest.append((text, norms))
            else:
                found[text] = label
        near = similar_keywords(self, [n for _, norms in rest for n in norms])
        for text, norms in rest:
            best: Label = (None, None)
            top = 0.0
            for _ in norms:
                for i, score in next(near):
                    if score > top:
                        top, best = score, self.entries[i][:2]
            found[text] = best
        if len(self.known) + len(found) > 1 << 17:
            self.known.clear()
        self.known.update(found)
        return found


@lru_cache(maxsize=8)
def matcher_of(keywords: tuple[tuple[str, tuple[str, ...]], ...], single: float = 82.0, several: float = 75.0) -> Matcher:
    return Matcher(keywords, single, several)


def matcher(config: EngineConfig = DEFAULT, keywords: Mapping[str, list[str]] | None = None) -> Matcher:
    """The matcher of a configuration's thresholds and a dictionary: labels by field, in order of precedence."""
    return matcher_of(tuple((f, tuple(ks)) for f, ks in (keywords or d.KEYWORDS).items()), config.single_word_score, config.multi_word_score)


def looks_like(labels: LabelMatcher, value: str | None) -> bool:
    """Whether a value is a label: it equals the label it matches, or is of at most three words that all match one."""
    norm = d.normalize(value) if value else ""
    if not norm:
        return False
    field, keyword = labels.match(value)
    if not field or not keyword:
        return False
    words = norm.split()
    return norm == d.normalize(keyword) or (len(words) <= 3 and all(labels.match(w)[0] for w in words))


def match_all(labels: LabelMatcher, texts: Iterable[str | None]) -> dict[str | None, Label]:
    """The labels of texts, each matched once."""
    return labels.match_all(texts) if isinstance(labels, Matcher) else {x: labels.match(x) for x in dict.fromkeys(texts)}


def like_all(labels: LabelMatcher, values: Iterable[str | None]) -> dict[str | None, bool]:
    """:func:`looks_like` for each of the values."""
    found = {v: (d.normalize(v) if v else "", label) for v, label in match_all(labels, values).items()}
    words = match_all(labels, [w for norm, label in found.values() if all(label) and norm.count(" ") < 3 for w in norm.split()])

    def like(norm: str, label: Label) -> bool:
        own = norm.split()
        return bool(own) and all(label) and (norm == d.normalize(label[1]) or (len(own) <= 3 and all(words[w][0] for w in own)))

    return {v: like(*x) for v, x in found.items()}


def match_label(text: str | None) -> Label:
    return matcher().match(text)


def looks_like_label(value: str | None) -> bool:
    return matcher().looks_like_label(value)


#: Types are objects here, as workers import this module without a session.
MATCH = T.StructType([T.StructField("field", T.StringType()), T.StructField("keyword", T.StringType())])
_KW = T.StructType([T.StructField("field_ord", T.IntegerType()), T.StructField("kw_ord", T.IntegerType())])
HITS = T.ArrayType(T.StructType([T.StructField("kw", _KW), T.StructField("score", T.DoubleType())]))


def match_function(labels: LabelMatcher):
    @F.pandas_udf(MATCH)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([labels.match(x) for x in s], columns=["field", "keyword"], dtype=object)

    return run


LINE = T.StructType([
    T.StructField("fields", T.ArrayType(T.StringType())), T.StructField("keywords", T.ArrayType(T.StringType())), T.StructField("field", T.StringType()), T.StructField("keyword", T.StringType()),
])


def match_line(texts: Column, line: Column, labels: LabelMatcher | None = None) -> Column:
    """(fields, keywords, field, keyword): the labels of a line's texts and, where none of them has any, that of the whole line."""
    labels = labels or matcher()

    @F.pandas_udf(LINE)
    def run(texts: pd.Series, line: pd.Series) -> pd.DataFrame:
        of = match_all(labels, (x for xs in texts for x in xs))
        fields = [[of[x][0] for x in xs] for xs in texts]
        bare = [all(f is None for f in fs) for fs in fields]
        whole = match_all(labels, (x for x, alone in zip(line, bare, strict=True) if alone))
        of_line = [whole[x] if alone else (None, None) for x, alone in zip(line, bare, strict=True)]
        return pd.DataFrame({
            "fields": pd.Series(fields, dtype=object), "keywords": pd.Series([[of[x][1] for x in xs] for xs in texts], dtype=object),
            "field": pd.Series([f for f, _ in of_line], dtype=object), "keyword": pd.Series([k for _, k in of_line], dtype=object),
        })

    # declared so that the filter which an explode of the labels implies is not moved below, where it would call this once more
    return run.asNondeterministic()(texts, line)


def label_like(value: Column, labels: LabelMatcher | None = None) -> Column:
    labels = labels or matcher()

    @F.pandas_udf(T.BooleanType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(like_all(labels, s).__getitem__)

    return run(value)


def label_like_each(values: Column, labels: LabelMatcher | None = None) -> Column:
    labels = labels or matcher()

    @F.pandas_udf(T.ArrayType(T.BooleanType()))
    def run(s: pd.Series) -> pd.Series:
        like = like_all(labels, (v for values in s for v in values))
        return s.map(lambda values: [like[v] for v in values])

    return run(values)


# ---------------------------------------------------------------- by joins


def candidates(texts: DataFrame) -> DataFrame:
    """(text, label_ord, norm) of the candidate labels of texts; those without any letter are left out."""
    out = texts.select("text", F.posexplode(label_candidates(F.col("text"))).alias("label_ord", "label"))
    return out.withColumn("norm", normalize_label("label")).where("norm <> ''").drop("label")


def dictionary(spark: SparkSession, keywords: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(kw, field_ord, kw_ord, field, keyword, kw_norm, kw_words, kw_rare): one row a keyword, as many as the dictionary given has."""
    return d.keywords(spark, keywords).withColumn("kw", F.struct("field_ord", "kw_ord"))


def exact_hits(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(text, label_ord, stage, kw): labels that equal a keyword. The dictionary is broadcast, so labels stay where they are."""
    return labels.join(F.broadcast(words), F.col("norm") == F.col("kw_norm")).select("text", "label_ord", F.lit(0).alias("stage"), "kw")


def subset_hits(labels: DataFrame, words: DataFrame) -> DataFrame:
    """(text, label_ord, stage, kw): labels that have all words of a keyword.

    A keyword is listed under its rarest word only and the others are looked for in the label, so that labels are neither
    grouped nor moved: words that many labels share would all meet in one task.
    """
    index = F.broadcast(words.select("kw", "kw_words", F.col("kw_rare").alias("word")))
    have = labels.select("text", "label_ord", F.array_distinct(F.split("norm", " ")).alias("have"))
    met = have.withColumn("word", F.explode("have")).join(index, "word").where(F.size(F.array_except("kw_words", "have")) == 0)
    return met.select("text", "label_ord", F.lit(1).alias("stage"), "kw")


def similar_keywords(labels: Matcher, norms: list[str], at_once: int = 1024) -> Iterator[list[tuple[int, float]]]:
    """For each normalised label the (number, score) of the keywords that it is similar enough to, in the order of the dictionary.

    Signatures of letter counts are compared for many labels together: what two words have in common, in any order, bounds the
    ratio of their matching blocks, and the mean of these bounds over a keyword's words its score. The others are scored.
    """
    for begin in range(0, len(norms), at_once):
        have = [n.split(" ") for n in norms[begin : begin + at_once]]
        words = [w for ws in have for w in ws]
        size = np.array([len(w) for w in words], np.int64)
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        sign = np.where((code >= 97) & (code <= 122), code - 97, 26 + code % 32)
        counts = np.bincount(np.repeat(np.arange(len(words)), size) * 58 + sign, minlength=58 * len(words)).reshape(-1, 58)
        bound = np.empty((len(words), len(labels.counts)))
        for k, has in enumerate(labels.counts):
            own = np.flatnonzero(has)
            bound[:, k] = 200.0 * np.minimum(counts[:, own], has[own]).sum(axis=1) / (size + labels.lengths[k])
        first = np.cumsum([0, *map(len, have[:-1])])
        open_ = np.maximum.reduceat(bound, first) @ labels.mean.T >= labels.least - 1e-6
        for ws, entries in zip(have, open_, strict=True):
            found = []
            for i in np.flatnonzero(entries).tolist():
                of = labels.entries[i][3]
                score = sum(max(_score(h, w) for h in ws) for w in of) / len(of)
                if score >= labels.least[i]:
                    found.append((i, score))
            yield found


def fuzzy_hits(labels: DataFrame, config: EngineConfig = DEFAULT, keywords: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(text, label_ord, kw, score): keywords whose words are similar enough to words of a label (text, label_ord, norm), on average.

    A label is judged inside its row, so rows are hits only; pairs of words are never rows.
    """
    known = matcher(config, keywords)
    places = [{"field_ord": i, "kw_ord": j} for i, (_, ks) in enumerate(known.keywords) for j in range(len(ks))]

    @F.pandas_udf(HITS)
    def near(s: pd.Series) -> pd.Series:
        return pd.Series([[{"kw": places[i], "score": score} for i, score in found] for found in similar_keywords(known, s.tolist())], dtype=object)

    return labels.select("text", "label_ord", F.explode(near("norm")).alias("h")).select("text", "label_ord", "h.kw", "h.score")


def match_texts(texts: DataFrame, config: EngineConfig = DEFAULT, keywords: Mapping[str, list[str]] | None = None) -> DataFrame:
    """(text, field, keyword) of distinct texts (text) that match a label, by joins with the dictionary.

    The same as :meth:`Matcher.match`: exact and word-subset hits by the earliest candidate, then stage, then keyword; texts without
    any are compared with all keywords at once, and only those whose letters come near are scored. Null and empty texts match
    nothing.
    """
    words = dictionary(texts.sparkSession, keywords)
    labels = candidates(texts.where("text <> ''").select("text").distinct())
    sure = exact_hits(labels, words).unionByName(subset_hits(labels, words)).groupBy("text").agg(F.min(F.struct("label_ord", "stage", "kw")).alias("h")).select("text", "h.kw")
    rest = labels.join(sure, "text", "left_anti")
    near = fuzzy_hits(rest, config, keywords)
    near = near.groupBy("text").agg(F.min(F.struct((-F.col("score")).alias("s"), "label_ord", "kw")).alias("h")).select("text", "h.kw")
    return sure.unionByName(near).join(F.broadcast(words.select("kw", "field", "keyword")), "kw").select("text", "field", "keyword")


def match(df: DataFrame, text: str = "text", config: EngineConfig = DEFAULT, keywords: Mapping[str, list[str]] | None = None) -> DataFrame:
    """df with ``field`` and ``keyword``, null where nothing matches; each distinct text is matched once, by :func:`match_texts`."""
    found = match_texts(df.select(F.col(text).alias("text")), config, keywords).withColumnRenamed("text", "__text")
    return df.join(found, F.col(text) == F.col("__text"), "left").drop("__text")


def label_like_values(df: DataFrame, text: str, config: EngineConfig = DEFAULT, keywords: Mapping[str, list[str]] | None = None) -> DataFrame:
    """df with ``label_like``, by joins: see :func:`looks_like`. The words of short values are matched as texts of their own."""
    values = df.select(F.col(text).alias("text")).where("text <> ''").distinct().withColumn("norm", normalize_label("text")).where("norm <> ''")
    short = values.select("text", F.split("norm", " ").alias("words")).where(F.size("words") <= 3).select("text", F.explode(F.array_distinct("words")).alias("word"))
    found = match_texts(values.select("text").unionByName(short.select(F.col("word").alias("text"))), config, keywords)
    whole = values.join(found, "text").select("text", "norm", normalize_label("keyword").alias("kw_norm"))
    every = short.join(found.select(F.col("text").alias("word"), F.lit(True).alias("hit")), "word", "left").groupBy("text").agg(F.every(F.coalesce("hit", F.lit(False))).alias("every"))
    like = whole.join(every, "text", "left").where((F.col("norm") == F.col("kw_norm")) | F.coalesce("every", F.lit(False))).select(F.col("text").alias("__text"), F.lit(True).alias("label_like"))
    return df.join(like, F.col(text) == F.col("__text"), "left").drop("__text").withColumn("label_like", F.coalesce("label_like", F.lit(False)))


def first_of(hits: DataFrame, words: DataFrame) -> DataFrame:
    """(text, field, keyword) of the earliest hit of each text."""
    best = hits.groupBy("text").agg(F.min(F.struct("label_ord", "stage", "kw")).alias("h")).select("text", "h.kw")
    return best.join(F.broadcast(words.select("kw", "field", "keyword")), "kw").select("text", "field", "keyword")


def adjacent_pairs(tokens: DataFrame) -> DataFrame:
    """(doc_id, field, value): a label and the token after it, unless that is a label too; the last of a field stays."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    seen = match(tokens).withColumns({"value": F.lead("text").over(w), "next_field": F.lead("field").over(w)})
    pairs = seen.where("field IS NOT NULL AND value IS NOT NULL AND next_field IS NULL")
    return pairs.groupBy("doc_id", "field").agg(F.max_by("value", "ord").alias("value"))
