"""License scans by a positional index of each template's rarest words."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.common import arrow_rows

#: Words of a template that may be missing or changed, as a share, and how far a word may be from its place.
MISSING, DRIFT = 0.25, 2
#: Texts are cut into words in blocks of so many bytes; places of a template are verified so many at a time.
TEXT_BLOCK, PLACES_BLOCK = 1 << 20, 1 << 12


@dataclass(frozen=True)
class Template:
    """A licence text or notice. phrases: word sequences that a place must hold; exact: no word may be missing or moved."""

    label: str
    text: str
    phrases: tuple[str, ...] = ()
    exact: bool = False


#: Base phrases: found wherever their words stand one after the other.
BASE = (
    Template("cc-by", "cc by", exact=True), Template("gpl", "general public license", exact=True), Template("reserved", "all rights reserved", exact=True),
)
#: Notices and opening sentences of licences in wide use.
NOTICES = (
    Template("mit", "Released under the MIT License", ("mit license",)),
    Template("mit", "Licensed under the MIT License", ("mit license",)),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software", ("permission is hereby granted", "sell copies")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies", ("with or without fee",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license", "2 0")),
    Template("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ("apache org licenses license 2 0",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("source and binary forms", "following conditions")),
    Template("bsd", "Licensed under the BSD License", ("bsd license",)),
    Template("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("general public license", "version 3")),
    Template("gpl-3.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", ("general public license", "version 3")),
    Template("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("general public license", "version 2")),
    Template("gpl-2.0", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version", ("general public license", "version 2")),
    Template("lgpl", "licensed under the GNU Lesser General Public License", ("lesser general public license",)),
    Template("agpl-3.0", "licensed under the GNU Affero General Public License, version 3", ("affero general public license",)),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license", "2 0")),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc", "4 0")),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa", "4 0")),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0",)),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

_SIGNS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Runs of digits, letters and signs beyond ASCII, A-Z in lower case."""
    return text.translate(_SIGNS).split()


class Vocabulary:
    """Words of the templates by number, and templates as arrays of them."""

    def __init__(self, templates: Sequence[Template]):
        self.templates = tuple(templates)
        self.sequences = [[w for w in words_of(t.text.encode())] for t in templates]
        if any(not s for s in self.sequences):
            raise ValueError("a template has no words")
        phrases = [[words_of(p.encode()) for p in t.phrases] for t in templates]
        self.words = sorted({w for s in self.sequences for w in s} | {w for ps in phrases for p in ps for w in p})
        self.number = {w: k for k, w in enumerate(self.words)}
        self.arrays = [self.numbers(s) for s in self.sequences]
        self.phrases = [[self.numbers(p) for p in ps] for ps in phrases]

    def numbers(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter((self.number.get(w, -1) for w in words), np.int32, len(words))

    def read(self, text: bytes) -> np.ndarray:
        """The number of each word of a text, -1 for words of no template; in blocks, so that a long text is never a list."""
        if len(text) <= TEXT_BLOCK:
            return self.numbers(words_of(text))
        signs, out, at = text.translate(_SIGNS), [], 0
        while at < len(signs):
            end = signs.find(b" ", at + TEXT_BLOCK)
            end = len(signs) if end < 0 else end
            out.append(self.numbers(signs[at:end].split()))
            at = end
        return np.concatenate(out)


def document_frequencies(docs: DataFrame, text: str, vocabulary: Vocabulary) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word of the vocabulary), over all documents. One row per task and word."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, seen = 0, np.zeros(len(vocabulary.words) + 1, np.int64)
        for b in batches:
            for t in b["text"]:
                seen[np.unique(vocabulary.read(t))] += 1  # -1 is the last
            n += len(b)
        yield pd.DataFrame({"word": np.append(np.arange(len(seen) - 1), -1), "n": np.append(seen[:-1], n)})

    got = docs.select(_bytes(text)).mapInPandas(run, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: int(r.n) for r in got}
    return counts.get(-1, 0), np.array([counts.get(k, 0) for k in range(len(vocabulary.words))])


def _bytes(text: str):
    return F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary").alias("text")


class PositionalIndex:
    """Postings (template, position) of the rarest words of each template.

    A place lacks at most ``missing`` of a template's words, so it holds at least one of any (that many + 1) of them: the
    template is listed under so many of its words with the highest IDF and under no other, and no place is lost.
    """

    def __init__(self, vocabulary: Vocabulary, documents: int, frequencies: np.ndarray, missing: float = MISSING, drift: int = DRIFT):
        self.vocabulary, self.drift = vocabulary, drift
        self.idf = np.log((documents + 1) / (frequencies + 1)) + 1e-9
        postings: dict[int, list[tuple[int, int]]] = {}
        self.need = []
        for k, (t, words) in enumerate(zip(vocabulary.templates, vocabulary.arrays, strict=True)):
            spare = 0 if t.exact else int(len(words) * missing)
            self.need.append(len(words) - spare)
            for at in np.lexsort((np.arange(len(words)), -self.idf[words]))[: spare + 1].tolist():
                postings.setdefault(int(words[at]), []).append((k, at))
        #: highest IDF first
        self.postings = dict(sorted(postings.items(), key=lambda kv: (-self.idf[kv[0]], kv[0])))

    def places(self, ids: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(template, start, end, share) of all places in a text: share is the IDF of the words found over that of all.

        The text's words are looked up, rarest first. Each hit fixes where the template would begin; hits that agree are
        one place. A place counts if enough words are within ``drift`` of their own positions and if it holds all phrases.
        Of places of a template that begin within ``drift`` of each other the best stays.
        """
        starts: dict[int, list[np.ndarray]] = {}
        order = np.argsort(ids, kind="stable")
        bounds = np.searchsorted(ids[order], np.arange(len(self.vocabulary.words) + 1))
        for word, listed in self.postings.items():
            hits = order[bounds[word] : bounds[word + 1]]
            if len(hits):
                for k, at in listed:
                    starts.setdefault(k, []).append(hits - at)
        out = []
        for k, found in sorted(starts.items()):
            begin = np.unique(np.concatenate(found))
            good = [self._verify(ids, k, begin[a : a + PLACES_BLOCK]) for a in range(0, len(begin), PLACES_BLOCK)]
            out += self._best(k, np.concatenate([g[0] for g in good]), np.concatenate([g[1] for g in good]))
        return out

    def _verify(self, ids: np.ndarray, k: int, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        words, drift = self.vocabulary.arrays[k], 0 if self.vocabulary.templates[k].exact else self.drift
        found = np.zeros((len(begin), len(words)), bool)
        for d in range(-drift, drift + 1):
            at = begin[:, None] + np.arange(d, len(words) + d)
            found |= (at >= 0) & (at < len(ids)) & (ids[np.clip(at, 0, len(ids) - 1)] == words)
        good = found.sum(axis=1) >= self.need[k]
        for phrase in self.vocabulary.phrases[k]:
            here = np.zeros(len(begin), bool)
            for d in range(-drift, len(words) - len(phrase) + drift + 1):
                at = begin[:, None] + np.arange(d, d + len(phrase))
                here |= ((at >= 0) & (at < len(ids)) & (ids[np.clip(at, 0, len(ids) - 1)] == phrase)).all(axis=1)
            good &= here
        weight = self.idf[words]
        return begin[good], (found[good] @ weight) / weight.sum()

    def _best(self, k: int, begin: np.ndarray, share: np.ndarray) -> list[tuple[int, int, int, float]]:
        exact, size = self.vocabulary.templates[k].exact, len(self.vocabulary.arrays[k])
        out: list[tuple[int, int, int, float]] = []
        for b, s in zip(begin.tolist(), share.tolist(), strict=True):
            if out and not exact and b - out[-1][1] <= self.drift:
                if s > out[-1][3]:
                    out[-1] = k, b, b + size, s
            else:
                out.append((k, b, b + size, s))
        return out


PLACE = "struct<label: string, base: boolean, start: bigint, end: bigint, share: double>"


def scan(docs: DataFrame, templates: Sequence[Template] = NOTICES, base: Sequence[Template] = BASE, text: str = "text", key: str = "doc_id", missing: float = MISSING) -> DataFrame:
    """(key, n_words, places): licence places of each document, in words from 0; ``end`` is exclusive and may lie beyond the text.

    Two passes over whole texts: one counts how many documents hold each licence word, as rarity comes from all documents;
    one looks up, intersects and verifies. Nothing is shuffled but those counts. The index grows with the templates given, not with
    the documents. Null texts count as empty and have no words; a null key is kept; repeated rows are rows of their own; an empty
    table gives an empty result. A place that begins before the text (its first words are missing) has a negative start. Other
    columns are not read.
    """
    arrow_rows(docs.sparkSession, 256)
    vocabulary = Vocabulary([*base, *templates])
    index = PositionalIndex(vocabulary, *document_frequencies(docs, text, vocabulary), missing)
    labels, n_base = [t.label for t in vocabulary.templates], len(base)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids = [vocabulary.read(t) for t in b["text"]]
            found = [[{"label": labels[k], "base": k < n_base, "start": s, "end": e, "share": x} for k, s, e, x in index.places(i)] for i in ids]
            yield pd.DataFrame({"key": b["key"], "n_words": [len(i) for i in ids], "places": found})

    rows = docs.select(F.col(f"`{key}`").alias("key"), _bytes(text)).mapInPandas(run, f"key {kind}, n_words long, places array<{PLACE}>")
    return rows.withColumnRenamed("key", key)


def op13(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The contract's columns of :func:`scan`; score is the largest share of any place, 0 without places."""
    listed = lambda places: F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")
    held = scan(docs).withColumn("base", F.filter("places", lambda p: p["base"]))
    start = F.transform("base", lambda p: p["start"])
    return held.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"), listed(F.col("base")).alias("base_labels"),
        listed(F.col("places")).alias("labels"), F.least(F.lit(1.0), F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0))).alias("score"),
        F.size("places").cast("long").alias("n_places"),
    )
