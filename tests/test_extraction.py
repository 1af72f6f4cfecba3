"""Expectations of matching, layout and extraction on small documents."""

from difflib import SequenceMatcher

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docweave.functions import dictionary as d
from docweave.functions.text import correct_text, indel_ratio
from docweave.operators.matching import looks_like_label, match_label
from docweave.plans.engine import extract_documents
from docweave.schemas import TOKENS


def box(x, y, w=60, h=20):
    return [[float(x), float(y)], [float(x + w), float(y)], [float(x + w), float(y + h)], [float(x), float(y + h)]]


def run(spark, *tokens):
    rows = [(1, k, text, 0.9, box(x, y), "unknown") for k, (text, x, y) in enumerate(tokens)]
    found = extract_documents(spark.createDataFrame(rows, TOKENS), post=False).first().asDict()
    return {k: v for k, v in found.items() if v is not None and k != "doc_id"}


@pytest.mark.parametrize(("text", "field"), [
    ("Nom", "nom"), ("Date.ofbirth", "date_naissance"), ("NOM/Surname", "nom"), ("Given name/Prénom", "nom"), ("given name", "prenom"), ("norm", "nom"), ("noms", "nom"),
    ("local de nascimento", "lieu_naissance"), ("local de nascimento 1", "date_naissance"), ("Nationite/ncbonFor", "nationalite"), ("Dute.depalpance", "date_naissance"), ("Random text", None),
    ("", None), (None, None), ("...", None), ("رقم بطاقة التعريف", "numero_document"), ("Passport No", "numero_document"), ("familyName", "nom"),
])
def test_precedence(text, field):
    assert match_label(text)[0] == field


def plain_match(text):
    """All keywords in order, with no bound that could skip one."""
    words, best, top = tuple(d.normalize(text).split()), None, 0.0
    for f, ks in d.KEYWORDS.items():
        for k in ks:
            if d.normalize(text) == d.normalize(k):
                return f, k
    for f, ks in d.KEYWORDS.items():
        for k in ks:
            if all(w in words for w in d.normalize(k).split()):
                return f, k
    for f, ks in d.KEYWORDS.items():
        for k in ks:
            kws = d.normalize(k).split()
            score = sum(max(SequenceMatcher(None, w, kw).ratio() * 100 for w in words) for kw in kws) / len(kws)
            if score >= (82 if len(kws) == 1 else 75) and score > top:
                best, top = (f, k), score
    return best or (None, None)


@settings(max_examples=60, deadline=None)
@given(st.sampled_from([k for ks in d.KEYWORDS.values() for k in ks if "/" not in k and "." not in k]), st.integers(0, 30), st.sampled_from("abcxyz é"))
def test_bounds_never_change_the_match(keyword, at, letter):
    text = keyword[: at % (len(keyword) + 1)] + letter + keyword[at % (len(keyword) + 1) + 1 :]
    if d.normalize(text):
        assert match_label(text) == plain_match(text)


NOISY = [
    "Nom", "NOM", "Prenom", "Prenom/Cwtpinc12", "Date de naissance", "Nationality", "Nationite/ncbonFor", "Dute.depalpance", "Autontea", "Dae drplration/Dc", "SeSOTaerpCoueurdesm", "Random text", "Given name/Prénom", "noms", "norm",
    "local de nascimento 1", "", None, "...", "a/b", "رقم بطاقة التعريف", "dat of brth", "numer de document", "x" * 300, "Lieu de naissanc/Place", "aut", "de", "date de", "É", "prenom nom sexe adresse",
]


def test_matching_by_joins_equals_the_matcher(spark):
    """Thresholds, dictionaries and the precedence of candidates, stages and keywords; repeated texts and clashing columns."""
    from pyspark.sql import functions as F

    from docweave.config import EngineConfig
    from docweave.operators import matching

    rng = __import__("random").Random(7)
    words = sorted({w for ks in d.KEYWORDS.values() for k in ks for w in k.split()})
    made = ["".join(rng.choice("aeinrst ") if rng.random() < 0.12 else c for c in " ".join(rng.sample(words, rng.randint(1, 3)))) for _ in range(150)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(NOISY + made + NOISY[:3])], "k int, text string").withColumn("word", F.lit("clash"))
    own = {"a": ["first thing", "nom"], "b": ["thing", "second thing here now five"]}
    for config, keywords in ((EngineConfig(), None), (EngineConfig(single_word_score=60.0, multi_word_score=50.0), None), (EngineConfig(multi_word_score=30.0), own)):
        labels = matching.matcher(config, keywords)
        got = {r.k: (r.field, r.keyword) for r in matching.match(df, "text", config, keywords).collect()}
        assert got == {r.k: labels.match(r.text) for r in df.collect()}
        like = {r.k: r.label_like for r in matching.label_like_values(df, "text", config, keywords).collect()}
        assert like == {r.k: labels.looks_like_label(r.text) for r in df.collect()}
    assert matching.match(df.limit(0)).count() == 0


def test_only_texts_without_a_sure_hit_are_scored(spark):
    from docweave.operators import matching

    df = spark.createDataFrame([("Nom",), ("date de naissance 2",), ("prenim",)], "text string")
    words = matching.dictionary(spark)
    labels = matching.candidates(df)
    sure = matching.exact_hits(labels, words).unionByName(matching.subset_hits(labels, words))
    assert {r.text for r in sure.select("text").distinct().collect()} == {"Nom", "date de naissance 2"}
    plan = matching.match_texts(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "CartesianProduct" not in plan and "LeftAnti" in plan


def test_labels_are_not_moved_to_find_keywords_in_them(spark):
    """Words that many labels share must not meet in one task, and pairs of labels and keywords are not grouped."""
    from docweave.operators import matching

    keywords = {"a": ["de la ville", "date de date", "ville"], "b": ["de", "autre mot"]}
    texts = ["la ville de", "date de", "de de", "ville", "mot de autre", "mot autre x", "la de", "vil le", "villede"]
    words = matching.dictionary(spark, keywords)
    labels = matching.candidates(spark.createDataFrame([(t,) for t in texts], "text string"))
    hits = matching.subset_hits(labels, words)
    got = sorted((r.text, r.kw.field_ord, r.kw.kw_ord) for r in hits.collect())
    assert got == sorted((t, i, j) for t in texts for i, ks in enumerate(keywords.values()) for j, k in enumerate(ks) if set(k.split()) <= set(t.split()))
    assert {r.kw_norm: r.kw_rare for r in words.collect()}["de la ville"] == "la"
    plan = hits._jdf.queryExecution().executedPlan().toString() + matching.exact_hits(labels, words)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Aggregate" not in plan and plan.count("BroadcastHashJoin") >= 2


def test_texts_matched_together_get_the_same_labels(spark):
    """Also after a text is known, and with a matcher that knows single texts only; a line takes one call of Python for its texts and as a whole."""
    from docweave.config import EngineConfig
    from docweave.functions.text import PHRASES, correct_text, indel_ratio
    from docweave.operators import layout, matching
    from docweave.operators.extract import line_values

    rng = __import__("random").Random(11)
    words = sorted({w for ks in d.KEYWORDS.values() for k in ks for w in k.split()})
    texts = NOISY + ["".join(rng.choice("aeinrst /") if rng.random() < 0.12 else c for c in " ".join(rng.sample(words, rng.randint(1, 4)))) for _ in range(300)]
    own = {"a": ["first thing", "nom"], "b": ["thing", "second thing here now five"]}
    for config, keywords in ((EngineConfig(), None), (EngineConfig(single_word_score=60.0, multi_word_score=50.0), None), (EngineConfig(multi_word_score=30.0), own)):
        labels = matching.matcher(config, keywords)
        for _ in range(2):
            assert labels.match_all(texts) == {x: labels.match(x) for x in texts}
            assert matching.like_all(labels, texts) == {x: matching.looks_like(labels, x) for x in texts}
    for x in filter(None, texts):
        scores = [(indel_ratio(x, p), -k) for k, (p, _) in enumerate(PHRASES)]
        assert correct_text(x, 70.0) == (PHRASES[-max(scores)[1]][0] if max(scores)[0] > 70.0 else x)
    items = layout.nest(spark.createDataFrame([(1, 0, "Nom", 0.9, [[0.0, 0.0]] * 4, "unknown")], TOKENS))
    plan = line_values(layout.build_lines(items))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 2


def test_own_matcher_and_thresholds_act(spark):
    import dataclasses

    from docweave.config import EngineConfig
    from docweave.operators import matching

    class Fixed:
        def match(self, text):
            return ("nom", "title") if text == "TITLE" else (None, None)

    def found(**more):
        tokens = [("TITLE", 100, 100), ("HUMBERT", 300, 100), ("Prenim", 100, 140), ("FLAVIEN", 300, 140)]
        rows = [(1, k, t, 0.9, box(x, y), "unknown") for k, (t, x, y) in enumerate(tokens)]
        return extract_documents(spark.createDataFrame(rows, TOKENS), post=False, **more).first().asDict()

    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])
    try:
        assert found(labels=Fixed())["nom"] == "HUMBERT" and found(labels=Fixed())["prenom"] is None
    finally:
        cloudpickle.unregister_pickle_by_value(sys.modules[__name__])
    assert found()["nom"] is None and found()["prenom"] == "FLAVIEN"
    assert found(config=dataclasses.replace(EngineConfig(), single_word_score=99.0, multi_word_score=99.0))["prenom"] is None
    assert found(labels=matching.matcher(keywords={"nom": ["title"]}))["nom"] == "HUMBERT"


@given(st.text(alphabet="abcde", max_size=12), st.text(alphabet="abcde", max_size=12))
def test_indel_ratio_is_by_longest_common_subsequence(a, b):
    p = [0] * (len(b) + 1)
    for x in a:
        q = [0]
        for j, y in enumerate(b):
            q.append(max(p[j] + 1 if x == y else 0, p[j + 1], q[-1]))
        p = q
    assert indel_ratio(a, b) == (100.0 if not a and not b else 200.0 * p[-1] / (len(a) + len(b)))


def test_correction_is_strict_and_minds_case():
    assert correct_text("Nationality", 88) == "nationality"
    assert correct_text("Surname", 88) == "Surname"
    assert correct_text("NOM", 88) == "NOM"


@given(st.text(max_size=30))
def test_normalize_twice_is_once(s):
    assert d.normalize(d.normalize(s)) == d.normalize(s)


def test_label_like():
    assert looks_like_label("Nom") and looks_like_label("nom prenom") and looks_like_label("NORM")
    assert not looks_like_label("HUMBERT") and not looks_like_label("") and not looks_like_label(None)


def test_dictionary_sizes():
    assert {f: len(k) for f, k in d.KEYWORDS.items()} == {
        "nom": 24, "prenom": 19, "date_naissance": 23, "lieu_naissance": 13, "nationalite": 12, "numero_document": 38, "date_delivrance": 24, "date_expiration": 22, "sexe": 8, "adresse": 11,
    }
    assert len(d.COUNTRIES) == 39 and len(d.CORRECTIONS) == 32


def test_labels_only_give_nothing(spark):
    assert run(spark, ("Nom", 100, 100), ("Prenom", 100, 130)) == {"status": "FAILED", "failure_code": "REJECTED_UNCLEAR_KEYS"}


def test_label_and_value_in_a_line(spark):
    got = run(spark, ("Nom", 100, 100), ("HUMBERT", 300, 100), ("Prenom", 100, 130), ("FLAVIEN", 300, 130), ("Nationality", 100, 160), ("FRANCAISE", 300, 160))
    assert (got["nom"], got["prenom"], got["nationalite"]) == ("HUMBERT", "FLAVIEN", "FRANCAISE")


def test_grid_pairs_by_nearest_x(spark):
    got = run(spark, ("Nom", 100, 100), ("Prenom", 300, 100), ("Sexe", 500, 100), ("HUMBERT", 110, 140), ("FLAVIEN", 290, 140), ("M", 505, 140))
    assert (got["nom"], got["prenom"], got["sexe"]) == ("HUMBERT", "FLAVIEN", "M")


def test_zone_goes_before_lines_and_keeps_the_odd_french_card(spark):
    got = run(spark, ("Nom", 100, 100), ("DUPONT", 300, 100), ("IDFRABERTHIER<<<<<<<<<<<<<<<<<<", 50, 500))
    assert got["nom"] == "RABERTHIER" and got["nationalite"] == "IDF"
    got = run(spark, ("P<FRAMARTIN<<JEAN-PIERRE<MARIE<<<<<<<<<<<<<", 50, 500))
    assert (got["nom"], got["prenom"], got["nationalite"]) == ("MARTIN", "Jean-Pierre Marie", "FRANÇAISE")


def test_birth_label_without_value_fails(spark):
    full = [("Nom", 100, 100), ("HUMBERT", 300, 100), ("Prenom", 100, 140), ("FLAVIEN", 300, 140), ("Nationality", 100, 180), ("BELGE", 300, 180), ("Passport No", 100, 220), ("X1234567", 300, 220)]
    assert run(spark, *full)["status"] == "SUCCESS"
    assert run(spark, *full, ("Date of birth", 100, 300))["failure_code"] == "REJECTED_UNCLEAR_KEYS"


def test_anchor_does_not_drift(spark):
    from docweave.operators.layout import build_lines, nest

    rows = [(1, k, f"t{y}", 0.9, box(0, y - 10, h=20), "unknown") for k, y in enumerate((30, 20, 10))]
    lines = [sorted(r.text.split()) for r in build_lines(nest(spark.createDataFrame(rows, TOKENS))).orderBy("line_no").collect()]
    assert lines == [["t10", "t20"], ["t30"]]


def test_nulls_empty_table_and_extra_columns(spark):
    from pyspark.sql import functions as F

    empty = spark.createDataFrame([], TOKENS)
    assert extract_documents(empty).count() == 0
    rows = [(1, 0, None, None, box(0, 0), None), (2, 0, "Nom", None, box(0, 0), None), (2, 1, "HUMBERT", None, box(100, 0), None)]
    got = {r.doc_id: r for r in extract_documents(spark.createDataFrame(rows, TOKENS).withColumn("field", F.lit("clash"))).collect()}
    assert got[1].status == "FAILED" and got[2].nom == "HUMBERT"


def test_command_line_asks_for_one_source_of_tokens(spark):
    from docweave.__main__ import main

    for args in ([], ["--recogniser", "a:b"], ["--tokens", "x", "--recogniser", "a:b"]):
        with pytest.raises(SystemExit):
            main([*args, "--out", "/nowhere"], spark)


def test_command_line_over_tokens(spark, tmp_path):
    from conftest import SF
    from docweave.__main__ import main
    from docweave.plans import synth

    tokens = synth.identity_tokens(spark, SF)
    tokens.write.parquet(str(tmp_path / "tokens"))
    said = main(["--tokens", str(tmp_path / "tokens"), "--out", str(tmp_path / "out"), "--show", "2"], spark)
    n = tokens.select("doc_id").distinct().count()
    assert said.startswith(f"images: {n}\n") and len(said.splitlines()) == 6
    header = next((tmp_path / "out").glob("part-*.csv")).read_text("utf-8-sig").splitlines()
    assert header[0].split(";")[:2] == ["image", "status"] and len(header) == n + 1


def test_sql_functions_equal_the_columns(spark):
    """Every SQL function against the expression or the matcher that it comes from, on odd texts."""
    from pyspark.sql import functions as F

    from docweave.functions import sql
    from docweave.functions import text as t
    from docweave.operators import layout, matching, mrz

    names = sql.register(spark)
    texts = ["Nom: DUPONT", "990101", "12 MAR/MAR 1990", "31121999", "<<JEAN-PIERRE<MARIE", "|€ _", " .x:- ", "m", "Nom/Surname", "P<FRAMARTIN<<JEAN<<<<<<<<<", "L898902C36UTO7408122F1204159ZE184226B<<<<<10", "D23145890<7408122F1204159<<<", "it's \\ 'odd'", "", None]
    df = spark.createDataFrame([(k, x) for k, x in enumerate(texts)], "k int, text string").withColumns({"field": F.lit("sexe"), "keyword": F.lit("nom"), "value": F.col("text")})
    df.createOrReplaceTempView("odd_texts")
    for name, (given, _, body) in sql._scalars().items():
        args = ", ".join(p.split()[0] for p in given.split(", "))
        a = [r[0] for r in spark.sql(f"SELECT docweave_{name}({args}) FROM odd_texts ORDER BY k").collect()]
        assert a == [r[0] for r in df.orderBy("k").select(body).collect()], name
    got = spark.sql("SELECT text, docweave_match(text) AS m, docweave_label_like(text) AS l, docweave_normalize(text) AS n, docweave_correct(text) AS c FROM odd_texts ORDER BY k").collect()
    assert [tuple(r.m) for r in got] == [matching.match_label(x) for x in texts] and [r.l for r in got] == [matching.looks_like_label(x) for x in texts]
    assert [r.n for r in got] == [None if x is None else d.normalize(x) for x in texts] and [r.c for r in got] == [None if x is None else correct_text(x, 88.0) for x in texts]
    zones = spark.sql("SELECT k, z.field, z.value FROM odd_texts, LATERAL docweave_zones(text) z").collect()
    want = df.select("k", F.explode(mrz.parse_line(mrz.mrz_line(F.col("text")))).alias("e")).select("k", "e.*").collect()
    assert sorted(map(tuple, zones)) == sorted(map(tuple, want)) and len({r.k for r in zones}) == 3
    rows = [(1, k, f"t{k}", 0.9, box(k * 37 % 100, k * 13 % 60), "unknown") for k in range(20)] + [(2, 0, None, None, box(0, 0), None)]
    nested = layout.nest(spark.createDataFrame(rows, TOKENS))
    a = spark.sql("SELECT doc_id, l.* FROM {n}, LATERAL docweave_lines(items) l", n=nested).collect()
    assert sorted(map(str, a)) == sorted(map(str, layout.build_lines(nested).drop("next_items").collect())) and len(a) > 3
    assert len(names) == len(set(names)) == len(sql._scalars()) + 6 and t
    plan = spark.sql("SELECT l.line_no, z.* FROM {n}, LATERAL docweave_lines(items) l, LATERAL docweave_zones(l.text) z", n=nested)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan


def test_fuzzy_hits_make_no_rows_of_pairs_of_words(spark):
    """Labels are judged inside their row: no join on letters, whose rows were words times keywords, and rows are hits only."""
    from docweave.operators import matching

    given = ["prenim", "surnam", "bcdfghjk", "x" * 300, "é", "رقمم", "naissanc", "dat of brth", "numer de document", "local de nasciment 1"]
    labels = spark.createDataFrame([(w, 0, w) for w in given], "text string, label_ord int, norm string")
    hits = matching.fuzzy_hits(labels)
    entries = matching.matcher().entries
    place = [(i, j) for i, ks in enumerate(d.KEYWORDS.values()) for j in range(len(ks))]
    want = {}
    for w in given:
        for (*_, words), at in zip(entries, place, strict=True):
            score = sum(max(SequenceMatcher(None, h, k).ratio() * 100 for h in w.split()) for k in words) / len(words)
            if score >= (82 if len(words) == 1 else 75):
                want[w, at] = score
    assert {(r.text, tuple(r.kw)): r.score for r in hits.collect()} == want != {}
    plan = hits._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "Aggregate" not in plan


def test_lines_name_their_input_once(spark):
    """What a lambda's body names is computed again for each element, so tokens were sorted again for each token of each line."""
    from pyspark.sql import functions as F

    from docweave.functions.sql import sql_text
    from docweave.operators import layout

    assert sql_text(layout.fold_lines(F.col("tokens"), 15.0)).count("tokens") == 1
    rows = [(1, k, str(k), 0.9, box(x, y), "unknown") for k, (x, y) in enumerate([(50, 0), (10, 14), (90, 15), (20, 29), (30, 30), (0, 5)])]
    nested = layout.nest(spark.createDataFrame(rows, TOKENS))
    assert [(r.line_no, r.text) for r in layout.build_lines(nested).orderBy("line_no").collect()] == [(0, "5 1 0"), (1, "3 2"), (2, "4")]


def test_mandatory_rows_hold_flags_only(spark):
    """Values of a document are not held for a wide row: the aggregate is by hash, its buffer a flag a field."""
    from pyspark.sql import functions as F

    from docweave.operators import gates

    full = [(1, f, "ab") for f in d.MANDATORY]
    rows = [*full, *((2, f, v) for _, f, v in full[1:]), *((3, f, " a ") for _, f, _ in full), *((4, f, v) for _, f, v in full), (4, d.MANDATORY[0], None), (5, "adresse", "ab")]
    ok = spark.createDataFrame(rows, "doc_id int, field string, value string").groupBy("doc_id").agg(gates.mandatory_rows(F.col("field"), F.col("value")).alias("ok"))
    assert {r.doc_id: r.ok for r in ok.collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert "SortAggregate" not in ok._jdf.queryExecution().executedPlan().toString()


def test_validator_values_are_distinct_inside_a_row(spark):
    """No aggregate is over exploded values: a task held 14 rows a customer."""
    from conftest import SF

    from docweave.plans import catalogue

    plan = catalogue.queries()["field_validators"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("Aggregate [")
    assert plan.count("Aggregate [") == 1 and "Generate" not in plan[at:] and "array_distinct" in plan[:at]
