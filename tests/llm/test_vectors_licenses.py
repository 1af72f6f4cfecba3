"""Whitening, clustering and licence scans against brute force; nulls, empties, ties, repeats, extra columns."""

import hashlib
import math
import re
from fractions import Fraction

import numpy as np
import pytest
from conftest import SF, rows_of
from hypothesis import given, settings
from hypothesis import strategies as st
from hypothesis.extra import numpy as hnp
from pyspark.sql import functions as F

from docweave.llm import block_norms, double_double, license_scan, queries, whitening
from docweave.llm.common import table

VECTORS = "vec_id long, embedding array<double>, component string, n string"
NAN, INF = float("nan"), float("inf")


# ---------------------------------------------------------------- double-double and eigenvectors


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**9), st.integers(1, 40), st.integers(1, 5))
def test_outer_sums_are_exact_beyond_doubles(seed, n, d):
    rng = np.random.default_rng(seed)
    high = rng.normal(size=(n, d)) * 10.0 ** rng.integers(-6, 7, d)
    low = high * rng.normal(size=(n, d)) * 1e-17
    got = double_double.outer_sums(high, low)
    exact = [[Fraction(a) + Fraction(b) for a, b in zip(r, s)] for r, s in zip(high.tolist(), low.tolist())]
    for i in range(d):
        for j in range(d):
            bound = n * Fraction(float(np.abs(high[:, i]).max() * np.abs(high[:, j]).max()))
            error = Fraction(float(got[0][i, j])) + Fraction(float(got[1][i, j])) - sum(r[i] * r[j] for r in exact)
            assert abs(error) <= bound * Fraction(2) ** -80


@pytest.mark.parametrize("n", [1, 2, 3, 8, 25, 64, 100])
@pytest.mark.parametrize("kind", ["random", "identity", "low rank", "repeated", "graded", "zero", "negative coupling"])
def test_divide_and_conquer_solves(n, kind):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    thin = rng.normal(size=(n, max(1, n // 3)))
    a = {
        "random": a + a.T, "identity": np.eye(n), "low rank": thin @ thin.T, "repeated": np.diag(np.repeat(rng.normal(size=n), 2)[:n]), "graded": (a * np.logspace(0, -8, n)).T @ (a * np.logspace(0, -8, n)),
        "zero": np.zeros((n, n)), "negative coupling": np.diag(np.arange(n, dtype=float)) - np.diag(np.ones(n - 1), 1) - np.diag(np.ones(n - 1), -1),
    }[kind]
    w, v = double_double.eigen(a)
    size = np.abs(a).max() or 1.0
    assert (np.diff(w) <= 1e-13 * size * n).all()
    assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size * n
    assert np.abs(a @ v - v * w).max() <= 1e-14 * size * n and np.abs(v.T @ v - np.eye(n)).max() <= 1e-14 * n


# ---------------------------------------------------------------- whitening


def plain_whitening(rows):
    """By exact fractions up to the covariance, then the library's solver."""
    xs = [[math.floor(64 * c) + 1_000_000 for c in v] for v in rows]
    n, d = len(xs), len(xs[0])
    s = [sum(x[k] for x in xs) for k in range(d)]
    v = np.array([[float(Fraction(sum((n * x[i] - s[i]) * (n * x[j] - s[j]) for x in xs), n**3)) for j in range(d)] for i in range(d)])
    return n, [sum((n * x[k] - s[k]) ** 2 for k in range(d)) for x in xs], v, np.array([[float(Fraction(n * x[k] - s[k], n)) for k in range(d)] for x in xs])


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(70, 6)) * [3, 2, 1, 0.5, 0.25, 0.1]).tolist()
    got = whitening.whiten_table(spark.createDataFrame([(k, r, "c", "n") for k, r in enumerate(rows)], VECTORS)).collect()
    n, far, v, x = plain_whitening(rows)
    w, q = np.linalg.eigh(v)
    w, q = w[::-1], q[:, ::-1]
    assert len(got) == 70 * 6 and {r.n for r in got} == {n}
    by = {(r.vec_id, r.component): r for r in got}
    y = np.array([[by[i, k + 1].whitened for k in range(6)] for i in range(70)])
    want = x @ q / np.sqrt(w)
    assert np.abs(y - want * np.sign((y * want).sum(axis=0))).max() < 1e-9
    assert all(by[i, 1].deviation == far[i] for i in range(70))
    assert all(abs(by[0, k + 1].explained / (w[k] / np.trace(v)) - 1) < 1e-9 for k in range(6)) and by[0, 1].identity_error < 1e-9


def test_whitening_of_the_table(spark):
    rows = queries.queries()["op11_whitening"](spark, SF).toPandas()
    vectors = table(spark, SF, "embeddings").toPandas()
    assert len(rows) == 32 * len(vectors) and set(rows["component"]) == set(range(1, 33))
    y = rows.pivot_table(index="vec_id", columns="component", values="whitened").to_numpy()
    assert np.abs(np.cov(y.T, bias=True) - np.eye(32)).max() < 1e-9 and rows["identity_error"].max() < 1e-9
    assert rows["explained"].between(0, 1).all() and rows.groupby("component")["explained"].first().is_monotonic_decreasing


def test_whitening_of_odd_rows(spark):
    v = lambda *c: list(map(float, c))
    odd = [(1, None, "", ""), (2, [1.0, None], "", ""), (3, v(NAN, 1), "", ""), (4, v(INF, 1), "", ""), (5, [], "", ""), (6, v(1), "", ""), (None, v(1, 2), "", ""), (7, v(3, 4), "", ""), (7, v(3, 4), "", ""), (8, v(5, -1), "", "")]
    got = whitening.whiten_table(spark.createDataFrame(odd, VECTORS)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (7, 1), (7, 1), (7, 2), (7, 2), (8, 1), (8, 2)] and {r.n for r in got} == {4}
    for rows in ([], [(1, v(1, 2), "", "")], [(1, v(1, 2), "", ""), (2, v(1, 2), "", "")], [(1, None, "", "")]):
        assert whitening.whiten_table(spark.createDataFrame(rows, VECTORS)).count() == 0
    huge = whitening.whiten_table(spark.createDataFrame([(1, v(1e300, 1), "", ""), (2, v(-1e300, 2), "", ""), (3, v(0, 4), "", "")], VECTORS)).collect()
    assert {r.deviation for r in huge if r.vec_id != 3} == {None}


def test_scatter_merges_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(whitening, "MERGED", 2)
    rows = [(k, [float(k % 7), float(k % 5)], "", "") for k in range(60)]
    df = spark.createDataFrame(rows, VECTORS).repartition(9)
    whole, d = whitening.fit_list(df, "vec_id", "embedding")
    model = whitening.fit(whole, d)
    v = plain_whitening([r[1] for r in rows])[2]
    assert np.abs((model.covariance[0] + model.covariance[1]) / 60 - v).max() < 1e-12 * np.abs(v).max()


# ---------------------------------------------------------------- clustering


def plain_clusters(rows, k=16, rounds=3):
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows], np.int64)
    order = sorted(range(len(rows)), key=lambda i: (hashlib.sha256(f"1:{rows[i][0]}".encode()).hexdigest(), x[i].tolist()))[:k]
    c = x[order].copy()
    near = lambda: ((x[:, None] - c[None]) ** 2).sum(axis=2)
    for _ in range(rounds):
        a = near().argmin(axis=1)
        for j in set(a.tolist()):
            c[j] = [int(s) // int((a == j).sum()) for s in x[a == j].sum(axis=0)]
    d = near()
    return d.argmin(axis=1), d.min(axis=1), c


def test_clusters_equal_sql(spark, duck):
    a, b = queries.queries()["op12_block_norms"](spark, SF).toPandas(), duck.execute(block_norms.OP12_SQL).df()
    assert sorted(a.columns) == sorted(b.columns) and rows_of(a) == rows_of(b)


def test_clusters_equal_brute_force_with_ties_and_repeats(spark):
    rng = np.random.default_rng(5)
    rows = [(int(k), rng.integers(-2, 3, 64).tolist()) for k in range(40)] + [(k, [1.0] * 64) for k in range(100, 130)] + [(7, [1.0] * 64)]
    rows = [(k, [float(c) / 64 for c in v]) for k, v in rows]
    got = block_norms.cluster(spark.createDataFrame([(*r, "", "") for r in rows], VECTORS).repartition(5)).collect()
    a, d, c = plain_clusters(rows)
    want = sorted((rows[i][0], int(a[i]), int(d[i]), hashlib.sha256(",".join(map(str, c[a[i]].tolist())).encode()).hexdigest()) for i in range(len(rows)))
    assert sorted((r.vec_id, r.cluster, r.distance, r.centroid_sha256) for r in got) == want
    assert {r.inertia for r in got} == {int(d.sum())} and all(r.cluster_inertia == int(d[a == r.cluster].sum()) for r in got)


def test_clusters_of_odd_rows(spark):
    one = [0.5] * 64
    odd = [(1, None, "", ""), (2, one[:63] + [None], "", ""), (3, one[:63] + [NAN], "", ""), (4, one[:63] + [-INF], "", ""), (5, one[:63], "", ""), (6, [], "", ""), (None, one, "", ""), (7, [1e300] * 64, "", "")]
    got = {r.vec_id: r for r in block_norms.cluster(spark.createDataFrame(odd, VECTORS)).collect()}
    assert set(got) == {None, 7} and got[7].distance == got[None].distance == 0 and got[7].cluster == 0
    assert block_norms.cluster(spark.createDataFrame([], VECTORS)).count() == 0


@settings(max_examples=80, deadline=None)
@given(hnp.arrays(np.int64, st.tuples(st.integers(1, 12), st.integers(1, 20)), elements=st.integers(-60, 60)), st.integers(1, 9))
def test_bounds_never_change_the_nearest(x, k):
    c = x[np.arange(k) * 7 % len(x)] + np.arange(k)[:, None] % 3
    cluster, distance, _ = block_norms.nearest(x, block_norms.block_norms(x), c)
    d = ((x[:, None] - c[None]) ** 2).sum(axis=2)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def test_bounds_prune():
    rng = np.random.default_rng(1)
    centroids = (rng.normal(size=(16, 64)) * np.repeat(rng.integers(1, 60, (16, 8)), 8, axis=1)).astype(np.int64)
    x = centroids[rng.integers(0, 16, 500)] + rng.integers(-5, 6, (500, 64))
    measured = block_norms.nearest(x, block_norms.block_norms(x), centroids)[2]
    assert measured < 1.2 * 500  # of 16 * 500 distances


# ---------------------------------------------------------------- licences


def plain_base(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    at = [(k, t.label) for t in license_scan.BASE for k in range(len(words)) if words[k : k + len(t.text.split())] == t.text.split()]
    return len(words), at


def test_base_places_equal_brute_force(spark):
    docs = {r.doc_id: r.text for r in table(spark, SF, "documents").collect()}
    rows = queries.queries()["op13_license_scan"](spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n, at = plain_base(docs[r.doc_id])
        assert (r.n_words, r.n_base) == (n, len(at)) and r.base_labels == ",".join(sorted({label for _, label in at}))
        assert (r.first_word, r.last_word) == ((min(at)[0], max(at)[0]) if at else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1 and (r.score > 0) == (r.labels != "")


def all_places(text, templates, missing=license_scan.MISSING, drift=license_scan.DRIFT):
    """Labels of the places that a try of every start finds; no index."""
    words, out = license_scan.words_of((text or "").encode()), set()
    for t in templates:
        want = license_scan.words_of(t.text.encode())
        phrases = [license_scan.words_of(p.encode()) for p in t.phrases]
        move, need = (0, len(want)) if t.exact else (drift, len(want) - int(len(want) * missing))
        for b in range(-len(want), len(words)):
            near = lambda k: words[max(0, b + k - move) : max(0, b + k + move + 1)]  # noqa: B023, E731
            window = words[max(0, b - move) : max(0, b + len(want) + move)]
            held = all(any(window[j : j + len(p)] == p for j in range(len(window))) for p in phrases)
            anchored = any(0 <= b + k < len(words) and words[b + k] == w for k, w in enumerate(want))
            if held and anchored and sum(w in near(k) for k, w in enumerate(want)) >= need:
                out.add(t.label)
    return out


LINES = [t.text for t in license_scan.NOTICES] + [
    "released under the mit licence", "Licensed, under: the Apache License; Version 2.0!", "This very work is licensed now under the GNU General Public License, version 3", "permission is hereby granted", "all rights not reserved",
    "the following conditions are met", "Redistribution or use of source and binary forms with or without modification is permitted provided that the following conditions are met",
]


@pytest.mark.parametrize("line", LINES)
def test_index_loses_no_place(line):
    templates = [*license_scan.BASE, *license_scan.NOTICES]
    vocabulary = license_scan.Vocabulary(templates)
    for seed in range(3):
        rng = np.random.default_rng(seed)
        index = license_scan.PositionalIndex(vocabulary, 100, rng.integers(0, 100, len(vocabulary.words)))
        text = "some words before " * int(rng.integers(0, 3)) + line + " and after" * int(rng.integers(0, 3))
        got = {templates[k].label for k, *_ in index.places(vocabulary.read(text.encode()))}
        assert got == all_places(text, templates)


def test_notices_are_found_and_prose_is_not(spark):
    docs = [
        (1, "x y Licensed under the Apache License, Version 2.0 (the License)"), (2, "we were licensed under the new version of the law"), (3, None), (4, ""), (5, "É CC BY-NC 4.0 Licensed under CC BY-NC 4.0."),
        (6, "All Rights reserved all rights RESERVED"), (6, "All Rights reserved all rights RESERVED"), (None, "released under the MIT license"), (7, "All rights reserved Kelvin"), (8, "a " * 1_500_000 + "all rights reserved"),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"labels": F.lit(1), "n_words": F.lit("x"), "key": F.lit(0)})
    got = {(r.doc_id, r.labels): r for r in license_scan.op13(spark, df).collect()}
    assert set(got) == {(1, "apache-2.0"), (2, ""), (3, ""), (4, ""), (5, "cc-by,cc-by-nc-4.0"), (6, "reserved"), (None, "mit"), (7, "reserved"), (8, "reserved")}
    assert got[6, "reserved"].n_base == 2 and got[6, "reserved"].last_word == 3 and got[8, "reserved"].first_word == 1_500_000 and got[3, ""].n_words == 0
    assert license_scan.op13(spark, df.limit(0)).count() == 0


def test_words_are_those_of_the_pattern():
    for text in ("Ab-c_d éK9\x7f~{z}`@[0:", "", " x y"):
        want = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        assert [w.decode() for w in license_scan.words_of(text.encode())] == want
