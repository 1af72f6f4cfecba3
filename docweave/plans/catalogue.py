"""Queries by name, one for each operator, and the same in DuckDB SQL where SQL can say it.

Inputs that the tables lack (labels, zones, boxes, images) are derived from them by expressions, in both languages.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.functions import dictionary as d
from docweave.functions import sql as sql_functions
from docweave.functions import text as t
from docweave.operators import decode, encode, gates, kernels, layout, matching, mrz, quality, regions
from docweave.operators.extract import merge_fields
from docweave.plans import engine, synth
from docweave.sources import images, shared, sinks, sqlite

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return register


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: The dictionary and the phrases as SQL values.
KEYWORD_VALUES = ", ".join(
    f"({i}, {j}, {_q(f)}, {_q(k)}, {_q(d.normalize(k))})" for i, (f, ks) in enumerate(d.KEYWORDS.items()) for j, k in enumerate(ks)
)
PHRASE_VALUES = ", ".join(f"({k}, {_q(p)})" for k, p in enumerate(d.CORRECTIONS))
COUNTRY_MAP = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in d.COUNTRIES.items()) + "}"
SIX_MAP = "map {" + ", ".join(f"{_q(k)}: {_q(v)}" for k, v in d.DATA_LINE_COUNTRIES.items()) + "}"
LETTERS_SQL = "translate(lpad(({0})::VARCHAR, 8, '0'), '0123456789', 'BCDFGHJKLQ')"


def letters(c) -> F.Column:
    return F.translate(F.lpad(c.cast("string"), 8, "0"), "0123456789", "BCDFGHJKLQ")


# ---------------------------------------------------------------- the whole


@query(synth.EXPECTED_SQL.replace("map {countries}", COUNTRY_MAP))
def extract_documents(spark, sf_dir):
    return engine.extract_documents(synth.identity_tokens(spark, sf_dir))


# ---------------------------------------------------------------- text


@query("""SELECT doc_id, trim(regexp_replace(translate(translate(text, 'qzx', '|§—'), '|§€«»—_', 'ISC<>--'), '\\s+', ' ', 'g')) AS fixed FROM documents""")
def fix_common_errors(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", t.fix_common_errors(F.translate("text", "qzx", "|§—")).alias("fixed"))


@query("""
SELECT w AS word, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(w, '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^a-z0-9\\x{0600}-\\x{06FF}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm
FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents)
""")
def normalize_label(spark, sf_dir):
    words = read(spark, sf_dir, "documents").select(F.explode(F.split("text", " ", -1)).alias("word")).distinct()
    return words.select("word", t.normalize_label(F.col("word")).alias("norm"))


@query("""
WITH w AS (SELECT n_nationkey, regexp_replace(n_name || '/ ' || lower(n_name) || '.x /a', '([a-zA-Z])\\.([a-zA-Z])', '\\1 \\2', 'g') AS whole FROM nation),
p AS (SELECT n_nationkey, list_concat([whole], list_filter(list_transform(string_split(whole, '/'), lambda s: trim(s)), lambda s: len(s) >= 2)) AS parts FROM w)
SELECT n_nationkey, (i - 1)::INT AS label_ord, parts[i] AS label FROM p, unnest(range(1, len(parts) + 1)) AS u(i)
""")
def bilingual_label_split(spark, sf_dir):
    label = F.concat("n_name", F.lit("/ "), F.lower("n_name"), F.lit(".x /a"))
    return read(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(t.label_candidates(label)).alias("label_ord", "label"))


def _variants(spark, sf_dir):
    """A phrase per customer: as it is, with a letter lost, with a letter changed, or doubled."""
    rows = read(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % len(d.CORRECTIONS)).cast("int").alias("ord"))
    c = rows.join(F.broadcast(d.corrections(spark)), "ord").withColumn("at", (1 + F.col("c_custkey") % F.length("keyword")).cast("int"))
    head, tail = F.expr("substring(keyword, 1, at - 1)"), F.expr("substring(keyword, at + 1)")
    made = F.when(F.col("c_custkey") % 5 == 0, F.col("keyword")).when(F.col("c_custkey") % 5 == 1, F.concat(head, tail)).when(F.col("c_custkey") % 5 == 2, F.concat(head, F.lit("x"), tail))
    return c.select("c_custkey", made.when(F.col("c_custkey") % 5 == 3, F.concat("keyword", F.lit(" "), "keyword")).otherwise(F.upper("keyword")).alias("text"))


_VARIANTS = f"""
ph(ord, keyword) AS (VALUES {PHRASE_VALUES}),
v AS (SELECT c_custkey, keyword, (1 + c_custkey % length(keyword))::INT AS pos FROM customer JOIN ph ON c_custkey % {len(d.CORRECTIONS)} = ord),
x AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN keyword WHEN 1 THEN substr(keyword, 1, pos - 1) || substr(keyword, pos + 1) WHEN 2 THEN substr(keyword, 1, pos - 1) || 'x' || substr(keyword, pos + 1)
  WHEN 3 THEN keyword || ' ' || keyword ELSE upper(keyword) END AS text FROM v)
"""


@query(f"""
WITH RECURSIVE {_VARIANTS},
u AS (SELECT DISTINCT text FROM x),
r AS (
  SELECT text, ord, keyword, 0 AS i, list_transform(range(1, length(keyword) + 1), lambda j: 0) AS p FROM u, ph
  UNION ALL
  SELECT text, ord, keyword, i + 1, list_transform(range(1, length(keyword) + 1), lambda j: list_max(list_transform(range(1, j + 1),
    lambda k: CASE WHEN text[i + 1] = keyword[k] THEN greatest(p[k], coalesce(p[k - 1], 0) + 1) ELSE p[k] END))) FROM r WHERE i < length(text)
), s AS (SELECT text, ord, keyword, 200.0 * p[len(p)] / (length(text) + length(keyword)) AS score FROM r WHERE i = length(text)),
b AS (SELECT text, keyword, row_number() OVER (PARTITION BY text ORDER BY score DESC, ord) AS n FROM s WHERE score > 88)
SELECT c_custkey, x.text, coalesce(keyword, x.text) AS corrected FROM x LEFT JOIN b ON x.text = b.text AND n = 1
""")
def keyword_correction(spark, sf_dir):
    return _variants(spark, sf_dir).select("c_custkey", "text", t.correct_keyword(F.col("text")).alias("corrected"))


@query("""
SELECT o_orderkey, CASE WHEN substr(s, 1, 2)::INT > 26 THEN substr(s, 5, 2) || '/' || substr(s, 3, 2) || '/19' || substr(s, 1, 2) ELSE substr(s, 5, 2) || '/' || substr(s, 3, 2) || '/20' || substr(s, 1, 2) END AS birth,
  substr(s, 5, 2) || '/' || substr(s, 3, 2) || '/20' || substr(s, 1, 2) AS expiry, '1' || s AS odd
FROM (SELECT o_orderkey, lpad(((o_orderkey * 7) % 100)::VARCHAR, 2, '0') || strftime(o_orderdate, '%m%d') AS s FROM orders)
""")
def mrz_date_pivot(spark, sf_dir):
    s = F.concat(F.lpad(((F.col("o_orderkey") * 7) % 100).cast("string"), 2, "0"), F.date_format("o_orderdate", "MMdd"))
    rows = read(spark, sf_dir, "orders").select("o_orderkey", s.alias("s"))
    return rows.select("o_orderkey", t.mrz_date(F.col("s"), True).alias("birth"), t.mrz_date(F.col("s"), False).alias("expiry"), t.mrz_date(F.concat(F.lit("1"), "s"), True).alias("odd"))


@query("""
SELECT o_orderkey, CASE o_orderkey % 6 WHEN 4 THEN strftime(o_orderdate, '%-d/%-m/%y') WHEN 5 THEN strftime(o_orderdate, '%d Mai %Y') ELSE strftime(o_orderdate, '%d/%m/%Y') END AS formatted FROM orders
""")
def free_date_format(spark, sf_dir):
    k = F.col("o_orderkey") % 6
    f = lambda p: F.date_format("o_orderdate", p)
    styles = (
        F.when(k == 0, f("ddMMyyyy")).when(k == 1, f("dd.MM.yyyy")).when(k == 2, F.concat(f("dd "), F.upper(f("MMM")), F.lit("/"), F.upper(f("MMM")), f(" yyyy")))
        .when(k == 3, f("dd MMM yyyy")).when(k == 4, f("d/M/yy")).otherwise(f("dd 'Mai' yyyy"))
    )
    return read(spark, sf_dir, "orders").select("o_orderkey", t.free_date(styles).alias("formatted"))


@query(f"""
WITH c AS (SELECT n_nationkey, (['FRA', 'DEU', 'TUN', 'XXX', 'ZAF'])[1 + n_nationkey % 5] AS code FROM nation)
SELECT n_nationkey, code, coalesce({COUNTRY_MAP}[code], code) AS by_name_line, coalesce({SIX_MAP}[code], code) AS by_data_line FROM c
""")
def country_lookup(spark, sf_dir):
    code = F.element_at(F.array(*map(F.lit, ("FRA", "DEU", "TUN", "XXX", "ZAF"))), (1 + F.col("n_nationkey") % 5).cast("int"))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", code.alias("code"))
    return rows.select("n_nationkey", "code", t.country(F.col("code"), d.COUNTRIES).alias("by_name_line"), t.country(F.col("code"), d.DATA_LINE_COUNTRIES).alias("by_data_line"))


@query(f"""
WITH l AS (SELECT c_custkey, (['Surname', 'Nom', 'Date of birth', 'Prénom'])[1 + c_custkey % 4] AS label, (['surname', 'nom', 'date of birth', 'prenom'])[1 + c_custkey % 4] AS keyword,
  ([' : ', ' - ', ' ', ''])[1 + (c_custkey // 4)::INT % 4] AS sep, {LETTERS_SQL.format('c_custkey')} AS v FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 3 THEN '' ELSE v END AS after FROM l
""")
def text_after_label(spark, sf_dir):
    pick = lambda c, *v: F.element_at(F.array(*map(F.lit, v)), (1 + c % len(v)).cast("int"))
    k = F.col("c_custkey")
    label, keyword = pick(k, "Surname", "Nom", "Date of birth", "Prénom"), pick(k, "surname", "nom", "date of birth", "prenom")
    text = F.concat(F.lit(" "), label, pick(F.floor(k / 4), " : ", " - ", " ", ""), letters(k), F.lit(" ."))
    return read(spark, sf_dir, "customer").select("c_custkey", t.after_label(text, keyword).alias("after"))


@query("""SELECT p_partkey, trim(p_name, ' :.-/' || chr(160)) AS trimmed FROM (SELECT p_partkey, '/ :' || p_name || '.-' || chr(160) AS p_name FROM part)""")
def merge_trim(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", t.merge_trim(F.concat(F.lit("/ :"), "p_name", F.lit(".- "))).alias("trimmed"))


@query(f"""
SELECT c_custkey, a[1] || lower(a[2:]) || ' ' || b[1] || lower(b[2:]) || '-' || a[1] || lower(a[2:]) AS name
FROM (SELECT c_custkey, {LETTERS_SQL.format('c_custkey')} AS a, {LETTERS_SQL.format('c_custkey + 17')} AS b FROM customer)
""")
def title_case(spark, sf_dir):
    a, b = letters(F.col("c_custkey")), letters(F.col("c_custkey") + 17)
    return read(spark, sf_dir, "customer").select("c_custkey", t.title_case(F.concat(F.lit("<"), a, F.lit("<<"), b, F.lit("-"), a, F.lit("<<<"))).alias("name"))


@query("""
SELECT l_orderkey, l_linenumber, (l_quantity + l_quantity + 50) / 2 AS cx, (l_tax + l_tax + l_discount * 100) / 2 AS cy FROM lineitem
""")
def token_centers(spark, sf_dir):
    corner = lambda x, y: F.array(x, y)
    x, y = F.col("l_quantity"), F.col("l_tax")
    box = F.array(corner(x, y), corner(x + 50, y), corner(x + 50, y + F.col("l_discount") * 100), corner(x, y + F.col("l_discount") * 100))
    cx, cy = t.center(box)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", cx.alias("cx"), cy.alias("cy"))


# ---------------------------------------------------------------- matching


def _labels(spark, sf_dir):
    """A label per customer: a dictionary entry in capitals, with dots for spaces, with a value, or with a second language."""
    n = sum(map(len, d.KEYWORDS.values()))
    starts = F.create_map(*[F.lit(x) for i, ks in enumerate(d.KEYWORDS.values()) for x in (i, sum(len(v) for v in list(d.KEYWORDS.values())[:i]))])
    kw = d.keywords(spark).withColumn("n", F.element_at(starts, F.col("field_ord")) + F.col("kw_ord"))
    rows = read(spark, sf_dir, "customer").join(F.broadcast(kw), F.col("c_custkey") % n == F.col("n"))
    k = F.floor(F.col("c_custkey") / n) % 4
    label = F.when(k == 0, F.upper("keyword")).when(k == 1, F.concat("keyword", F.lit(":"))).when(k == 2, F.concat("keyword", F.lit(" "), letters(F.col("c_custkey")))).otherwise(F.concat(letters(F.col("c_custkey")), F.lit("/"), "keyword"))
    return rows.select("c_custkey", label.alias("label"))


_KW = f"kw(field_ord, kw_ord, field, keyword, kw_norm) AS (VALUES {KEYWORD_VALUES})"
_LABEL_ROWS = f"""
kn AS (SELECT *, row_number() OVER (ORDER BY field_ord, kw_ord) - 1 AS n, count(*) OVER () AS total FROM kw),
l AS (SELECT c_custkey, CASE (c_custkey // total) % 4 WHEN 0 THEN upper(keyword) WHEN 1 THEN keyword || ':' WHEN 2 THEN keyword || ' ' || {LETTERS_SQL.format('c_custkey')}
  ELSE {LETTERS_SQL.format('c_custkey')} || '/' || keyword END AS label FROM customer JOIN kn ON c_custkey % total = n)"""
_LABELS = f"""{_KW},{_LABEL_ROWS},
w AS (SELECT c_custkey, regexp_replace(label, '([a-zA-Z])\\.([a-zA-Z])', '\\1 \\2', 'g') AS whole FROM l),
c AS (SELECT c_custkey, CASE WHEN contains(whole, '/') THEN list_concat([whole], list_filter(list_transform(string_split(whole, '/'), lambda s: trim(s)), lambda s: len(s) >= 2)) ELSE [whole] END AS parts FROM w),
e AS (SELECT c_custkey, i AS label_ord, trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(parts[i], '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^a-z0-9\\x{{0600}}-\\x{{06FF}}\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS norm
  FROM c, unnest(range(1, len(parts) + 1)) AS u(i))
"""


def _by_hits(spark, sf_dir, hits):
    """Labels by one stage of the matcher only."""
    rows, words = _labels(spark, sf_dir), matching.dictionary(spark)
    found = matching.first_of(hits(matching.candidates(rows.select(F.col("label").alias("text")).distinct()), words), words)
    return rows.join(found, F.col("label") == F.col("text")).select("c_custkey", "field", "keyword")


@query(f"""WITH {_LABELS}, h AS (SELECT c_custkey, field, keyword, row_number() OVER (PARTITION BY c_custkey ORDER BY label_ord, field_ord, kw_ord) AS r FROM e JOIN kw ON norm = kw_norm)
SELECT c_custkey, field, keyword FROM h WHERE r = 1""")
def label_match_exact(spark, sf_dir):
    return _by_hits(spark, sf_dir, matching.exact_hits)


@query(f"""WITH {_LABELS}, h AS (SELECT c_custkey, field, keyword, row_number() OVER (PARTITION BY c_custkey ORDER BY label_ord, field_ord, kw_ord) AS r
  FROM e JOIN kw ON norm <> '' AND list_has_all(string_split(norm, ' '), string_split(kw_norm, ' ')))
SELECT c_custkey, field, keyword FROM h WHERE r = 1""")
def label_match_subset(spark, sf_dir):
    return _by_hits(spark, sf_dir, matching.subset_hits)


@query(f"""WITH {_LABELS}, h AS (
  SELECT c_custkey, field, keyword, label_ord, CASE WHEN norm = kw_norm THEN 0 ELSE 1 END AS stage, field_ord, kw_ord FROM e JOIN kw ON norm <> '' AND list_has_all(string_split(norm, ' '), string_split(kw_norm, ' '))
  UNION ALL SELECT c_custkey, field, keyword, label_ord, 0, field_ord, kw_ord FROM e JOIN kw ON norm = kw_norm
), b AS (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY label_ord, stage, field_ord, kw_ord) AS r FROM h)
SELECT c_custkey, field, keyword FROM b WHERE r = 1""")
def label_match(spark, sf_dir):
    """All stages; these labels hold a dictionary entry each, so none needs the fuzzy one."""
    return matching.match(_labels(spark, sf_dir), "label").select("c_custkey", "field", "keyword")


#: The longest block that w[alo:ahi] and k[blo:bhi] share, as its length and (less of) where it begins: length * 10^6 + (999 - i) * 1000 + (999 - j); 0 without any.
_BLOCK = """coalesce(list_max(flatten(list_transform(range({alo}, {ahi}), lambda i: list_transform(range({blo}, {bhi}), lambda j: CASE WHEN w[i] = k[j]
  THEN len(list_filter(range(1, least({ahi} - i, {bhi} - j) + 1), lambda t: substr(w, i, t) = substr(k, j, t))) * 1000000 + (999 - i) * 1000 + 999 - j ELSE 0 END)))), 0)"""


def _match_sql(texts: str) -> str:
    """CTEs after ``kw`` that end in ``found`` (text, field, keyword): all stages of the matcher over the texts of a query."""
    norm = "trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace({0}, '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^a-z0-9\\x{{0600}}-\\x{{06FF}}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
    return f"""
tx AS (SELECT DISTINCT text FROM ({texts})),
tw AS (SELECT text, regexp_replace(text, '([a-zA-Z])\\.([a-zA-Z])', '\\1 \\2', 'g') AS whole FROM tx),
tp AS (SELECT text, CASE WHEN contains(whole, '/') THEN list_concat([whole], list_filter(list_transform(string_split(whole, '/'), lambda s: trim(s)), lambda s: len(s) >= 2)) ELSE [whole] END AS parts FROM tw),
tl AS (SELECT text, i AS label_ord, {norm.format('parts[i]')} AS norm FROM tp, unnest(range(1, len(parts) + 1)) AS u(i)),
la AS (SELECT * FROM tl WHERE norm <> ''),
sure AS (SELECT text, label_ord, CASE WHEN norm = kw_norm THEN 0 ELSE 1 END AS stage, field_ord, kw_ord FROM la JOIN kw ON list_has_all(string_split(norm, ' '), string_split(kw_norm, ' '))),
lw AS (SELECT DISTINCT text, label_ord, unnest(string_split(norm, ' ')) AS w FROM la WHERE text NOT IN (SELECT text FROM sure)),
ks AS (SELECT field_ord, kw_ord, len(string_split(kw_norm, ' ')) AS n, unnest(string_split(kw_norm, ' ')) AS k, unnest(range(1, len(string_split(kw_norm, ' ')) + 1)) AS pos FROM kw),
pa AS (SELECT w, k FROM (SELECT DISTINCT w FROM lw), (SELECT DISTINCT k FROM ks)),
rb AS (
  SELECT w, k, 1 AS alo, len(w) + 1 AS ahi, 1 AS blo, len(k) + 1 AS bhi, {_BLOCK.format(alo='1', ahi='len(w) + 1', blo='1', bhi='len(k) + 1')} AS b FROM pa
  UNION ALL
  SELECT w, k, alo, ahi, blo, bhi, {_BLOCK.format(alo='alo', ahi='ahi', blo='blo', bhi='bhi')} FROM (
    SELECT w, k, CASE WHEN side = 0 THEN alo ELSE 999 - (b // 1000) % 1000 + b // 1000000 END AS alo, CASE WHEN side = 0 THEN 999 - (b // 1000) % 1000 ELSE ahi END AS ahi,
      CASE WHEN side = 0 THEN blo ELSE 999 - b % 1000 + b // 1000000 END AS blo, CASE WHEN side = 0 THEN 999 - b % 1000 ELSE bhi END AS bhi FROM rb, range(0, 2) AS s(side) WHERE b > 0) WHERE alo < ahi AND blo < bhi
),
ws AS (SELECT w, k, 2.0::DOUBLE * sum(b // 1000000) / (len(w) + len(k)) * 100 AS score FROM rb GROUP BY w, k),
wb AS (SELECT text, label_ord, k, max(score) AS score FROM lw JOIN ws USING (w) GROUP BY text, label_ord, k),
fz AS (SELECT text, label_ord, field_ord, kw_ord, any_value(n) AS n, list_reduce(list(score ORDER BY pos), lambda a, b: a + b) / any_value(n) AS score FROM wb JOIN ks USING (k) GROUP BY text, label_ord, field_ord, kw_ord),
hit AS (SELECT text, 0 AS far, label_ord, stage, field_ord, kw_ord FROM sure UNION ALL SELECT text, -score, label_ord, 2, field_ord, kw_ord FROM fz WHERE score >= CASE WHEN n = 1 THEN 82 ELSE 75 END),
hr AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY far, label_ord, stage, field_ord, kw_ord) AS r FROM hit),
found AS (SELECT text, field, keyword, kw_norm FROM hr JOIN kw USING (field_ord, kw_ord) WHERE r = 1)"""


@query(f"""WITH RECURSIVE {_KW}, {_VARIANTS}, {_match_sql('SELECT text FROM x')}
SELECT c_custkey, x.text, field, keyword FROM x LEFT JOIN found USING (text)""")
def label_match_fuzzy(spark, sf_dir):
    return matching.match(_variants(spark, sf_dir)).select("c_custkey", "text", "field", "keyword")


_LIKE_NORM = "trim(regexp_replace(regexp_replace(strip_accents(lower(regexp_replace(label, '([a-z])([A-Z])', '\\1 \\2', 'g'))), '[^a-z0-9\\x{0600}-\\x{06FF}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"""WITH RECURSIVE {_KW}, {_LABEL_ROWS},
ww AS (SELECT DISTINCT label AS value, {_LIKE_NORM} AS norm FROM l), sw AS (SELECT value, unnest(string_split(norm, ' ')) AS word FROM ww WHERE norm <> '' AND len(string_split(norm, ' ')) <= 3),
{_match_sql('SELECT value AS text FROM ww UNION ALL SELECT word FROM sw')},
ev AS (SELECT value, bool_and(found.text IS NOT NULL) AS ok FROM sw LEFT JOIN found ON word = found.text GROUP BY value)
SELECT c_custkey, label, coalesce(found.text IS NOT NULL AND (norm = kw_norm OR coalesce(ok, false)), false) AS label_like FROM l JOIN ww ON label = ww.value LEFT JOIN found ON found.text = label LEFT JOIN ev ON ev.value = label""")
def label_like_values(spark, sf_dir):
    return matching.label_like_values(_labels(spark, sf_dir), "label")


@query(f"""
WITH s AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'Nom' WHEN 'system' THEN 'Nationality' ELSE {LETTERS_SQL.format('conv_id * 10 + turn')} END AS text,
  CASE role WHEN 'user' THEN 'nom' WHEN 'system' THEN 'nationalite' END AS field FROM conversations),
p AS (SELECT conv_id, turn, field, lead(text) OVER w AS value, lead(field) OVER w AS next_field FROM s WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id AS doc_id, field, arg_max(value, turn) AS value FROM p WHERE field IS NOT NULL AND value IS NOT NULL AND next_field IS NULL GROUP BY conv_id, field
""")
def adjacent_pairs(spark, sf_dir):
    text = F.when(F.col("role") == "user", "Nom").when(F.col("role") == "system", "Nationality").otherwise(letters(F.col("conv_id") * 10 + F.col("turn")))
    return matching.adjacent_pairs(read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("int").alias("ord"), text.alias("text")))


# ---------------------------------------------------------------- layout


def _boxed(spark, sf_dir):
    """Lines of an order as tokens on a page."""
    # numbered by the document's key and before boxes are made, so that these are not moved, and nesting needs no exchange of its own
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    lines = lines.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("l_linenumber", "l_partkey", "l_suppkey")))
    x, y = (F.col("l_partkey") % 500).cast("double"), (F.floor("l_extendedprice") % 60).cast("double")
    box = F.array(F.array(x, y), F.array(x, y), F.array(x, y), F.array(x, y))
    return lines.select("doc_id", "ord", F.concat(F.lit("T"), F.col("l_partkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("text"), F.lit(1.0).alias("confidence"), box.alias("box"), F.lit("unknown").alias("type"))


_BOXED = """
t AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS ord, 'T' || l_partkey || '-' || l_linenumber AS text,
  (l_partkey % 500)::DOUBLE AS cx, (floor(l_extendedprice)::BIGINT % 60)::DOUBLE AS cy FROM lineitem),
s AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY cy, ord) AS n FROM t),
f AS (SELECT doc_id, n, cy AS anchor, 0 AS line_no FROM s WHERE n = 1
  UNION ALL SELECT s.doc_id, s.n, CASE WHEN abs(s.cy - anchor) < 15 THEN anchor ELSE s.cy END, line_no + CASE WHEN abs(s.cy - anchor) < 15 THEN 0 ELSE 1 END FROM f JOIN s ON s.doc_id = f.doc_id AND s.n = f.n + 1),
lines AS (SELECT s.doc_id, line_no, cx, cy, ord, text FROM f JOIN s USING (doc_id, n))
"""


@query(f"WITH RECURSIVE {_BOXED} SELECT doc_id, line_no, string_agg(text, ' ' ORDER BY cx, cy, ord) AS text FROM lines GROUP BY doc_id, line_no")
def layout_lines(spark, sf_dir):
    return layout.build_lines(layout.nest(_boxed(spark, sf_dir))).select("doc_id", "line_no", "text")


@query(f"""WITH RECURSIVE {_BOXED}, p AS (SELECT a.doc_id, a.line_no, a.ord, b.text, row_number() OVER (PARTITION BY a.doc_id, a.ord ORDER BY abs(b.cx - a.cx), b.cx, b.cy, b.ord) AS r
  FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.line_no = a.line_no + 1)
SELECT doc_id, line_no, ord, text AS below FROM p WHERE r = 1""")
def nearest_next_row(spark, sf_dir):
    lines = layout.with_next_line(layout.build_lines(layout.nest(_boxed(spark, sf_dir)))).where("next_items IS NOT NULL")
    rows = lines.select("doc_id", "line_no", "next_items", F.explode("items").alias("i"))
    return rows.select("doc_id", "line_no", "i.ord", layout.nearest_text(t.center(F.col("i.box"))[0], F.col("next_items")).alias("below"))


# ---------------------------------------------------------------- zones


def _people(spark, sf_dir):
    k = F.col("c_custkey")
    code = F.element_at(F.array(*map(F.lit, ("FRA", "DEU", "TUN", "XYZ"))), (1 + k % 4).cast("int"))
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    born = F.concat(two(k % 100), two(1 + k % 12), two(1 + k % 28))
    sex = F.element_at(F.array(F.lit("M"), F.lit("F"), F.lit("<")), (1 + k % 3).cast("int"))
    return read(spark, sf_dir, "customer").select(k, code.alias("code"), born.alias("born"), sex.alias("sex"), letters(k).alias("a"), letters(k * 3).alias("b"), F.lpad(k.cast("string"), 7, "0").alias("n"))


_PEOPLE = f"""
p AS (SELECT c_custkey, (['FRA', 'DEU', 'TUN', 'XYZ'])[1 + c_custkey % 4] AS code, lpad((c_custkey % 100)::VARCHAR, 2, '0') AS yy, lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') AS mm,
  lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') AS dd, (['M', 'F', '<'])[1 + c_custkey % 3] AS sex, {LETTERS_SQL.format('c_custkey')} AS a, {LETTERS_SQL.format('c_custkey * 3')} AS b, lpad(c_custkey::VARCHAR, 7, '0') AS n FROM customer),
z AS (SELECT *, dd || '/' || mm || '/' || CASE WHEN yy::INT > 26 THEN '19' ELSE '20' END || yy AS birth FROM p)
"""


def _entries(rows: DataFrame, entries) -> DataFrame:
    return rows.select("c_custkey", F.explode(entries).alias("e")).select("c_custkey", "e.field", "e.value")


@query(f"""WITH {_PEOPLE}
SELECT c_custkey, 'numero_document' AS field, 'AB' || n AS value FROM z UNION ALL SELECT c_custkey, 'nationalite', coalesce({SIX_MAP}[code], code) FROM z UNION ALL SELECT c_custkey, 'date_naissance', birth FROM z
UNION ALL SELECT c_custkey, 'sexe', sex FROM z WHERE sex <> '<' UNION ALL SELECT c_custkey, 'date_expiration', '15/04/2012' FROM z""")
def mrz_td3_parse(spark, sf_dir):
    line = F.rpad(F.concat(F.lit("AB"), "n", F.lit("6"), "code", "born", F.lit("2"), "sex", F.lit("1204159")), 44, "<")
    return _entries(_people(spark, sf_dir), mrz.td3(line))


@query(f"""WITH {_PEOPLE}
SELECT c_custkey, 'numero_document' AS field, n AS value FROM z UNION ALL SELECT c_custkey, 'sexe', sex FROM z WHERE sex <> '<' UNION ALL SELECT c_custkey, 'date_naissance', birth FROM z WHERE sex <> '<'
UNION ALL SELECT c_custkey, 'date_expiration', '15/04/2012' FROM z WHERE sex <> '<'""")
def mrz_td3_positional(spark, sf_dir):
    line = F.rpad(F.concat("n", F.lit("<<<"), F.substring("code", 1, 2), F.lit("0"), "born", F.lit("2"), "sex", F.lit("1204159")), 44, "<")
    return _entries(_people(spark, sf_dir), F.coalesce(mrz.td3(line), mrz.td3_positional(line)))


@query(f"""WITH {_PEOPLE}
SELECT c_custkey, 'numero_document' AS field, a || '7' AS value FROM z UNION ALL SELECT c_custkey, 'date_naissance', birth FROM z UNION ALL SELECT c_custkey, 'date_expiration', '15/04/2012' FROM z
UNION ALL SELECT c_custkey, 'sexe', sex FROM z WHERE sex <> '<'""")
def mrz_td1_parse(spark, sf_dir):
    line = F.concat("a", F.lit("7<"), "born", F.lit("2"), "sex", F.lit("1204159<"))
    return _entries(_people(spark, sf_dir), mrz.td1(line))


@query(f"""WITH {_PEOPLE}
SELECT c_custkey, 'nationalite' AS field, coalesce({COUNTRY_MAP}[code], code) AS value FROM z UNION ALL SELECT c_custkey, 'nom', a FROM z
UNION ALL SELECT c_custkey, 'prenom', b[1] || lower(b[2:]) || ' ' || a[1] || lower(a[2:]) FROM z""")
def mrz_name_line(spark, sf_dir):
    start = F.when(F.col("c_custkey") % 3 == 0, "P<").when(F.col("c_custkey") % 3 == 1, "<").otherwise("")
    return _entries(_people(spark, sf_dir), mrz.name_line(F.rpad(F.concat(start, "code", "a", F.lit("<<"), "b", F.lit("<"), "a"), 50, "<")))


@query(f"""WITH {_PEOPLE}
SELECT c_custkey, CASE c_custkey % 5 WHEN 3 THEN NULL WHEN 4 THEN 'data' ELSE 'name' END AS kind FROM z""")
def mrz_routing(spark, sf_dir):
    k = F.col("c_custkey") % 5
    line = F.when(k == 0, F.concat(F.lit("p<"), "code", "a", F.lit("<<x"))).when(k == 1, F.concat(F.lit("<"), "code", "a", F.lit("<<abc"))).when(k == 2, F.concat(F.lit("IDFRA"), "a", F.lit("<<<<"))).when(k == 3, F.concat("a", "b")).otherwise(F.concat("n", F.lit("<<<<<<<<<"), "n"))
    rows = _people(spark, sf_dir).withColumn("line", mrz.mrz_line(line))
    return rows.select("c_custkey", F.when(F.col("line").isNull(), None).when(mrz.is_name_line(F.col("line")), "name").otherwise("data").alias("kind"))


ZONES_SQL = """
SELECT d.doc_id, z.field, min_by(z.value, struct(l.line_no, i.pos)) AS value
FROM {documents} d, LATERAL docweave_lines(d.items) l, LATERAL posexplode(l.items) i, LATERAL docweave_zones(i.col.text) z
WHERE docweave_zone_line(i.col.text) IS NOT NULL GROUP BY d.doc_id, z.field
"""
_ZONE_FIELDS = ("nom", "prenom", "nationalite", "numero_document", "date_naissance", "sexe", "date_expiration")


@query(f"""
WITH e AS (SELECT * FROM ({synth.EXPECTED_SQL.replace('map {countries}', COUNTRY_MAP)}) WHERE doc_id % 4 = 3)
SELECT * FROM ({' UNION ALL '.join(f"SELECT doc_id, '{f}' AS field, {f} AS value FROM e" for f in _ZONE_FIELDS)}) WHERE value IS NOT NULL
""")
def zones_in_sql(spark, sf_dir):
    """Lines and zones of documents by table functions, in SQL only."""
    sql_functions.register(spark)
    return spark.sql(ZONES_SQL, documents=layout.nest(synth.identity_tokens(spark, sf_dir)))


# ---------------------------------------------------------------- predicates, gates, merges


_VALUE_SQL = """
v AS (SELECT c_custkey AS k, unnest([c_name, c_mktsegment, upper(n_name), 'Rue ' || c_custkey, c_custkey::VARCHAR, 'PX' || lpad(c_custkey::VARCHAR, 6, '0'), strftime(DATE '1990-01-01' + (c_custkey % 9000)::INT, '%d.%m.%Y'),
  strftime(DATE '1990-01-01' + (c_custkey % 9000)::INT, '%d%m%Y'), 'm', 'Nationality', 'Jean-Pierre', 'É', '١٢٣٤٥٦٧٨', 'محمد']) AS value FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""


def _validator_sql() -> str:
    """The patterns in the dialect of DuckDB: it has no lookahead and writes code points otherwise."""
    out = []
    for f, p in d.VALIDATORS.items():
        banned = re.findall(r"\(\?!\.\*(\w+)\)", p)
        plain = re.sub(r"\\u([0-9A-F]{4})", r"\\x{\1}", re.sub(r"\(\?!.*?\)", "", p)).replace(r"\d", r"\p{Nd}")
        flag = "(?i)" if f in d.ANY_CASE else ""
        extra = "".join(f" AND NOT contains(lower(value), {_q(w)})" for w in banned)
        out.append(f"SELECT k, value, {_q(f)} AS field, regexp_matches(value, {_q(flag + plain)}){extra} AS ok FROM u")
    return f"WITH {_VALUE_SQL}, u AS (SELECT DISTINCT * FROM v) " + " UNION ALL ".join(out)


@query(_validator_sql())
def field_validators(spark, sf_dir):
    day = F.date_add(F.lit("1990-01-01").cast("date"), (F.col("c_custkey") % 9000).cast("int"))
    k = F.col("c_custkey").cast("string")
    of_key = F.array(
        F.concat(F.lit("Rue "), k), k, F.concat(F.lit("PX"), F.lpad(k, 6, "0")), F.date_format(day, "dd.MM.yyyy"), F.date_format(day, "ddMMyyyy"),
        F.lit("m"), F.lit("Nationality"), F.lit("Jean-Pierre"), F.lit("É"), F.lit("١٢٣٤٥٦٧٨"), F.lit("محمد"),
    )
    # values are made distinct inside a key's row: only the columns that they come from are grouped, not 14 rows a customer
    people = read(spark, sf_dir, "customer").join(F.broadcast(read(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    keys = people.groupBy("c_custkey").agg(F.collect_set(F.struct("c_name", "c_mktsegment", "n_name")).alias("rows"))
    of_rows = F.flatten(F.transform("rows", lambda r: F.array(r["c_name"], r["c_mktsegment"], F.upper(r["n_name"]))))
    rows = keys.select(F.col("c_custkey").alias("k"), F.explode(F.array_distinct(F.concat(of_rows, of_key))).alias("value"))
    rows = rows.withColumn("field", F.explode(F.array(*map(F.lit, d.VALIDATORS))))
    return rows.select("k", "value", "field", t.is_valid(F.col("field"), F.col("value")).alias("ok"))


def _found(spark, sf_dir):
    """Fields per customer, some missing, blank or too short."""
    k = F.col("c_custkey")
    rows = [(f, i) for i, f in enumerate(d.MAIN)]
    fields = spark.createDataFrame(rows, "field string, i int")
    value = F.when((k + F.col("i")) % 7 == 0, F.lit(None)).when((k + F.col("i")) % 11 == 0, " ").when((k + F.col("i")) % 13 == 0, "X ").otherwise(letters(k))
    return read(spark, sf_dir, "customer").select("c_custkey").crossJoin(F.broadcast(fields)).select(k.alias("doc_id"), "field", "i", value.alias("value"))


_FOUND = f"""
fields(field, i) AS (VALUES {', '.join(f'({_q(f)}, {i})' for i, f in enumerate(d.MAIN))}),
g AS (SELECT c_custkey AS doc_id, field, i, CASE WHEN (c_custkey + i) % 7 = 0 THEN NULL WHEN (c_custkey + i) % 11 = 0 THEN ' ' WHEN (c_custkey + i) % 13 = 0 THEN 'X ' ELSE {LETTERS_SQL.format('c_custkey')} END AS value FROM customer, fields)
"""


@query(f"WITH {_FOUND} SELECT doc_id, bool_and(coalesce(length(trim(value)) >= 2, false)) AS ok FROM g WHERE field <> 'date_naissance' GROUP BY doc_id")
def mandatory_gate(spark, sf_dir):
    return _found(spark, sf_dir).groupBy("doc_id").agg(gates.mandatory_rows(F.col("field"), F.col("value")).alias("ok"))


_SOME = {f: 2 + i for i, f in enumerate(d.FIELDS)}


@query(f"""
WITH f AS (SELECT c_custkey AS doc_id, {', '.join(f"CASE WHEN c_custkey % {m} <> 0 THEN CASE WHEN c_custkey % 17 = 0 THEN ' X ' ELSE {LETTERS_SQL.format('c_custkey')} END END AS {f}" for f, m in _SOME.items())} FROM customer),
o AS (SELECT *, {' + '.join(f'({f} IS NOT NULL)::INT' for f in _SOME)} AS n_fields, {' AND '.join(f'coalesce(length(trim({f})) >= 2, false)' for f in d.MANDATORY)} AS clear FROM f)
SELECT doc_id, n_fields, CASE WHEN clear AND doc_id % 5 <> 0 THEN 'SUCCESS' ELSE 'FAILED' END AS status, CASE WHEN NOT clear OR doc_id % 5 = 0 THEN 'REJECTED_UNCLEAR_KEYS' WHEN n_fields < 3 THEN 'REJECTED_INCOMPLETE' END AS failure_code FROM o
""")
def document_outcome(spark, sf_dir):
    """Fields counted, and what becomes of a document: every fifth has a label without a value."""
    k = F.col("c_custkey")
    value = F.when(k % 17 == 0, " X ").otherwise(letters(k))
    rows = read(spark, sf_dir, "customer").select(k.alias("doc_id"), *[F.when(k % m != 0, value).alias(f) for f, m in _SOME.items()])
    columns = {f: F.col(f) for f in d.FIELDS}
    status, code = gates.outcome(columns, F.col("doc_id") % 5 == 0)
    return rows.select("doc_id", gates.n_fields(columns).alias("n_fields"), status.alias("status"), code.alias("failure_code"))


@query(f"WITH {_FOUND} SELECT doc_id, field FROM g WHERE (doc_id + i) % 3 = 0 AND NOT coalesce(length(trim(value)) >= 2, false)")
def label_without_value(spark, sf_dir):
    wide = _found(spark, sf_dir).groupBy("doc_id").agg(
        *[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in d.MAIN], F.collect_set(F.when((F.col("doc_id") + F.col("i")) % 3 == 0, F.col("field"))).alias("seen")
    )
    return wide.select("doc_id", F.explode(gates.labels_without_value(F.col("seen"), {f: F.col(f) for f in d.MAIN})).alias("field"))


@query("""SELECT l_orderkey AS doc_id, f AS field, arg_min(v, (l_linenumber, l_partkey)) AS value FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'nom' ELSE 'prenom' END AS f, 'V' || l_partkey AS v FROM lineitem) GROUP BY l_orderkey, f""")
def first_wins_merge(spark, sf_dir):
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "N", "nom").otherwise("prenom").alias("field"), F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("value"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    return merge_fields(rows)


@query("""SELECT l_orderkey AS doc_id, f AS field, arg_min(v, (-length(v), l_linenumber, l_partkey)) AS value FROM (SELECT *, CASE WHEN l_returnflag = 'N' THEN 'adresse' ELSE 'lieu_naissance' END AS f, repeat('V', (l_partkey % 4)::INT + 1) || l_partkey AS v FROM lineitem) GROUP BY l_orderkey, f""")
def longest_wins_merge(spark, sf_dir):
    value = F.concat(F.expr("repeat('V', CAST(l_partkey % 4 AS INT) + 1)"), F.col("l_partkey").cast("string"))
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_returnflag") == "N", "adresse").otherwise("lieu_naissance").alias("field"), value.alias("value"), F.struct("l_linenumber", "l_partkey").alias("ord"))
    return merge_fields(rows)


# ---------------------------------------------------------------- quality


def _metrics(spark, sf_dir):
    c = F.col
    return read(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", (100 + c("l_partkey") * 7 % 2400).cast("int").alias("width"), (100 + c("l_orderkey") * 11 % 1400).cast("int").alias("height"), (c("l_extendedprice") % 500).alias("sharpness"),
        (c("l_quantity") * 2).alias("contrast"), (c("l_discount") * 8).alias("eta"), (c("l_quantity") / 2).alias("char_height"), (c("l_tax") / 4).alias("density"), (c("l_discount") * 6).alias("reflection"), (c("l_extendedprice") % 256).alias("brightness"),
    )


def _steps(value: str, steps, op: str = ">=") -> str:
    bounds, rest = steps
    return "CASE " + " ".join(f"WHEN {value} {op} {b} THEN {s}" for b, s in bounds) + f" ELSE {rest} END"


_METRICS = f"""
m AS (SELECT l_orderkey, l_linenumber, l_partkey, (100 + l_partkey * 7 % 2400)::INT AS width, (100 + l_orderkey * 11 % 1400)::INT AS height, l_extendedprice % 500 AS sharpness, l_quantity * 2 AS contrast, l_discount * 8 AS eta,
  l_quantity / 2 AS char_height, l_tax / 4 AS density, l_discount * 6 AS reflection, l_extendedprice % 256 AS brightness FROM lineitem),
s AS (SELECT *, {_steps('sharpness', quality.SHARPNESS)} AS sharpness_score, {_steps('contrast', quality.CONTRAST)} AS contrast_score, {_steps('eta', quality.ETA)} AS eta_score,
  round_even(({_steps('width::BIGINT * height', quality.PIXELS)}) * 0.6::DOUBLE + ({_steps('char_height', quality.CHAR_HEIGHT)}) * 0.4::DOUBLE, 0)::INT AS resolution_score,
  {_steps('density', quality.DENSITY)} AS density_score, {_steps('reflection', quality.REFLECTION, '<')} AS reflection_score,
  CASE WHEN brightness BETWEEN 70 AND 250 THEN 100 WHEN (brightness >= 50 AND brightness < 70) OR (brightness > 250 AND brightness <= 253) THEN 85 WHEN (brightness >= 35 AND brightness < 50) OR (brightness > 253 AND brightness <= 255) THEN 70 ELSE 30 END AS brightness_score FROM m),
c AS (SELECT *, least(sharpness_score, contrast_score, eta_score, CASE WHEN eta > 0.85 AND sharpness > 4000 AND contrast > 150 THEN 1000 ELSE resolution_score END) AS critical_min FROM s),
g AS (SELECT *, round_even(greatest(0.0::DOUBLE, least(100.0::DOUBLE, 0.0::DOUBLE + sharpness_score * 0.30::DOUBLE + contrast_score * 0.25::DOUBLE + eta_score * 0.20::DOUBLE + resolution_score * 0.15::DOUBLE + density_score * 0.05::DOUBLE + reflection_score * 0.03::DOUBLE + brightness_score * 0.02::DOUBLE, critical_min + 15.0::DOUBLE)), 0)::INT AS score FROM c),
q AS (SELECT *, CASE WHEN width < 200 OR height < 150 OR char_height < 4 OR critical_min < 45 OR density < 0.001 THEN 'REJECTED' WHEN score >= 70 THEN 'ACCEPTED' WHEN score >= 55 THEN 'WARNING' ELSE 'REJECTED' END AS status FROM g)
"""
_KEY = ("l_orderkey", "l_linenumber", "l_partkey")


@query(f"WITH {_METRICS} SELECT l_orderkey, l_linenumber, l_partkey, sharpness_score, contrast_score, eta_score, resolution_score, density_score, reflection_score, brightness_score FROM s")
def quality_buckets(spark, sf_dir):
    return quality.scores(_metrics(spark, sf_dir)).select(*_KEY, *[f"{n}_score" for n in quality.WEIGHTS])


@query(f"WITH {_METRICS} SELECT l_orderkey, l_linenumber, l_partkey, critical_min, score, status FROM q")
def quality_gate(spark, sf_dir):
    return quality.combine(quality.scores(_metrics(spark, sf_dir))).select(*_KEY, "critical_min", "score", "status")


@query(f"WITH {_METRICS} SELECT l_orderkey, l_linenumber, l_partkey, status FROM q WHERE status IN ('ACCEPTED', 'WARNING')")
def accepted_images(spark, sf_dir):
    """Images that pass the gate before recognition."""
    return gates.quality_gate(quality.combine(quality.scores(_metrics(spark, sf_dir)))).select(*_KEY, "status")


@query(f"""WITH {_METRICS} SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([
  CASE WHEN width < 200 OR height < 150 THEN 'Résolution trop faible (' || width || 'x' || height || ' px) — minimum requis : 200x150 px' END,
  CASE WHEN char_height < 4 THEN 'Taille des caractères trop petite (' || printf('%.1f', char_height) || ' px) — minimum requis : 4 px' END,
  CASE WHEN sharpness_score < 60 THEN 'Netteté des caractères insuffisante (texte flou)' END, CASE WHEN contrast_score < 60 THEN 'Contraste local entre le texte et l''arrière-plan trop faible' END,
  CASE WHEN eta_score < 60 THEN 'Lisibilité de la binarisation du texte dégradée' END, CASE WHEN resolution_score < 60 THEN 'Résolution ou taille des caractères insuffisante pour une extraction fiable' END,
  CASE WHEN density_score < 60 THEN 'Densité de structures textuelles très faible (texte absent ou illisible)' END, CASE WHEN reflection_score < 60 THEN 'Reflets ou éblouissements importants détectés sur le document' END,
  CASE WHEN brightness_score < 60 THEN 'Luminosité globale inadaptée (' || CASE WHEN brightness < 60 THEN 'trop sombre' ELSE 'trop claire' END || ')' END], lambda x: x IS NOT NULL), ' | ') AS reasons FROM q""")
def quality_reasons(spark, sf_dir):
    return quality.combine(quality.scores(_metrics(spark, sf_dir))).select(*_KEY, F.array_join("reasons", " | ").alias("reasons"))


def _of_image(kind: str, rule: Callable[[np.ndarray], object]):
    """A kernel of the engine over images that are arrays of numbers."""
    return F.pandas_udf(lambda images: images.map(lambda x: rule(np.stack(x) if len(x) and np.ndim(x[0]) else np.asarray(x))), kind)


def _planes(spark, sf_dir):
    """Embeddings as gray images of 8 x 8: (id, plane), row by row."""
    level = F.transform("embedding", lambda e: F.floor((e.cast("double") + 1) * 127.5).cast("int"))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), level.alias("plane"))


def _plane(x: np.ndarray) -> np.ndarray:
    return x.reshape(8, 8).astype(np.uint8)


_PIXELS = "x AS (SELECT vec_id AS id, i - 1 AS pos, floor((embedding[i]::DOUBLE + 1) * 127.5)::INT AS level FROM embeddings, unnest(range(1, 65)) AS u(i))"
_OTSU = f"""{_PIXELS}, h AS (SELECT id, level, count(*) AS n FROM x GROUP BY id, level),
c AS (SELECT id, level, sum(n) OVER w::DOUBLE AS n0, sum(n * level) OVER w::DOUBLE AS s0, sum(n) OVER a::DOUBLE AS na, sum(n * level) OVER a::DOUBLE AS sa, sum(n * level * level) OVER a::DOUBLE AS qa FROM h
  WINDOW w AS (PARTITION BY id ORDER BY level ROWS UNBOUNDED PRECEDING), a AS (PARTITION BY id)),
b AS (SELECT id, level, qa / na - (sa / na) * (sa / na) AS v, CASE WHEN na > n0 THEN n0 / na * ((na - n0) / na) * (s0 / n0 - (sa - s0) / (na - n0)) * (s0 / n0 - (sa - s0) / (na - n0)) ELSE 0 END AS b,
  CASE WHEN na > n0 THEN abs((sa - s0) / (na - n0) - s0 / n0) ELSE 0 END AS gap FROM c)"""


@query(f"WITH {_OTSU} SELECT id, round(CASE WHEN max(v) > 1e-9 THEN max(b) / max(v) ELSE 0 END, 6) AS eta, round(CASE WHEN max(v) > 1e-9 THEN arg_max(gap, (b, -level)) ELSE 0 END, 6) AS contrast FROM b GROUP BY id")
def otsu_separation(spark, sf_dir):
    found = _of_image("array<double>", lambda x: kernels.otsu(_plane(x))[1:])("plane")
    return _planes(spark, sf_dir).select("id", found.alias("o")).select("id", F.round(F.col("o")[0], 6).alias("eta"), F.round(F.col("o")[1], 6).alias("contrast"))


@query(f"WITH {_PIXELS} SELECT id, level, count(*) AS n FROM x GROUP BY id, level")
def gray_histogram(spark, sf_dir):
    levels = _of_image("array<long>", lambda x: kernels.histogram(_plane(x)))("plane")
    return _planes(spark, sf_dir).select("id", F.posexplode(levels).alias("level", "n")).where("n > 0")


@query(f"WITH {_PIXELS} SELECT id, (pos // 8)::INT AS y, (pos % 8)::INT AS x, level FROM x")
def png_round_trip(spark, sf_dir):
    """Planes written as PNG files by one kernel and decoded by another."""
    def there_and_back(x: np.ndarray) -> np.ndarray:
        return decode.decode(encode.png(np.repeat(_plane(x)[..., None], 3, axis=2)))[..., 0].ravel()

    levels = _of_image("array<int>", there_and_back)("plane")
    rows = _planes(spark, sf_dir).select("id", F.posexplode(levels).alias("pos", "level"))
    return rows.select("id", F.floor(F.col("pos") / 8).cast("int").alias("y"), (F.col("pos") % 8).cast("int").alias("x"), "level")


@query(f"WITH {_PIXELS} SELECT id, round(avg(level), 6) AS brightness FROM x GROUP BY id")
def mean_brightness(spark, sf_dir):
    return _planes(spark, sf_dir).select("id", F.round(_of_image("double", lambda x: kernels.brightness(_plane(x)))("plane"), 6).alias("brightness"))


@query(f"""WITH {_PIXELS}, g AS (SELECT id, pos // 8 AS y, pos % 8 AS x, level FROM x),
n AS (SELECT a.id, a.x, a.y, sum(b.level * (CASE WHEN abs(dx) + abs(dy) = 0 THEN -4 ELSE 1 END)) AS l FROM g a, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)
  JOIN g b ON b.id = a.id AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END GROUP BY a.id, a.x, a.y)
SELECT id, round(var_pop(l) * 4096)::BIGINT AS sharpness_4096 FROM n GROUP BY id""")
def laplacian_variance(spark, sf_dir):
    variance = _of_image("double", lambda x: kernels.sharpness(_plane(x), np.ones((8, 8), bool)))("plane")
    return _planes(spark, sf_dir).select("id", F.round(variance * 4096).cast("long").alias("sharpness_4096"))


_RGB = """r AS (SELECT vec_id AS id, least(255, greatest(0, floor(embedding[i]::DOUBLE * 900 + 100)))::INT AS r, least(255, greatest(0, floor(embedding[1 + i % 64]::DOUBLE * 900 + 150)))::INT AS g, least(255, greatest(0, floor(embedding[1 + (i + 1) % 64]::DOUBLE * 900 + 240)))::INT AS b
  FROM embeddings, unnest(range(1, 65)) AS u(i)), p AS (SELECT id, greatest(r, g, b) AS v, CASE WHEN greatest(r, g, b) = 0 THEN 0 ELSE round(255.0 * (greatest(r, g, b) - least(r, g, b)) / greatest(r, g, b)) END AS s FROM r),
a AS (SELECT id, avg(v) AS m, stddev_pop(v) AS d FROM p GROUP BY id)"""


@query(f"WITH {_RGB} SELECT id, round(CASE WHEN any_value(d) < 25 AND any_value(m) > 200 THEN 0 ELSE avg((v > 250 AND s < 20 AND v > m + 35)::INT) END, 6) AS reflection FROM p JOIN a USING (id) GROUP BY id")
def reflection_ratio(spark, sf_dir):
    def byte(k: int, plus: int):
        return F.transform("embedding", lambda e, i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.get("embedding", (i + k) % 64).cast("double") * 900 + plus))).cast("int"))

    ratio = _of_image("double", lambda x: kernels.glare(x.T.reshape(8, 8, 3).astype(np.uint8)))(F.array(byte(2, 240), byte(1, 150), byte(0, 100)))
    return read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.round(ratio, 6).alias("reflection"))


def _ink_tiles(spark, sf_dir, side: int) -> DataFrame:
    """Embeddings as ink on pages of 64 x 64: a row of a page each, in square tiles."""
    rows = read(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 64).alias("id"), (F.col("vec_id") % 64).cast("int").alias("row"), F.transform("embedding", lambda e: (e.cast("double") > 0.04).cast("int")).alias("ink"))
    strips = rows.groupBy("id", F.floor(F.col("row") / side).cast("int").alias("strip")).agg(F.collect_list(F.struct("row", "ink")).alias("rows"))

    @F.pandas_udf("array<struct<x0: int, mask: binary>>")
    def cut(strip: pd.Series, rows: pd.Series) -> pd.Series:
        def one(k: int, given) -> list[dict]:
            page = np.zeros((side, 64), np.uint8)
            for r in given:
                page[r["row"] - k * side] = r["ink"]
            return [{"x0": x, "mask": page[:, x : x + side].tobytes()} for x in range(0, 64, side)]

        return pd.Series([one(k, r) for k, r in zip(strip, rows, strict=True)])

    tiles = strips.select("id", (F.col("strip") * side).alias("y0"), F.explode(cut("strip", "rows")).alias("t"))
    return tiles.select("id", "y0", "t.x0", F.lit(side).alias("height"), F.lit(side).alias("width"), "t.mask")


_INK = """
ink AS (SELECT (vec_id // 64)::BIGINT AS id, (vec_id % 64)::INT AS y, (i - 1)::INT AS x FROM embeddings, unnest(range(1, 65)) AS u(i) WHERE embedding[i]::DOUBLE > 0.04),
reach(id, y, x, root) AS (
  SELECT id, y, x, y * 64 + x FROM ink
  UNION
  SELECT n.id, n.y, n.x, root FROM reach r JOIN ink n ON n.id = r.id AND n.y BETWEEN r.y - 1 AND r.y + 1 AND n.x BETWEEN r.x - 1 AND r.x + 1 WHERE n.y * 64 + n.x > root
),
own AS (SELECT id, y, x, min(root) AS root FROM reach GROUP BY id, y, x)"""


@query(f"""WITH RECURSIVE {_INK}
SELECT id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS width, max(y) - min(y) + 1 AS height, count(*) AS area FROM own GROUP BY id, root""")
def page_regions(spark, sf_dir):
    """Connected parts of pages of 64 x 64, found in tiles of 16 x 16."""
    return regions.regions(_ink_tiles(spark, sf_dir, 16))


def _parts(rows: DataFrame, *columns: str) -> DataFrame:
    """(id, parts): the rows of an id as one array of numbers, in the order of ``ord``."""
    return rows.groupBy("id").agg(F.array_sort(F.collect_list(F.array(*[F.col(c).cast("double") for c in ("ord", *columns)]))).alias("parts"))


@query("""
WITH k AS (SELECT l_suppkey AS id, l_orderkey * 10 + l_linenumber AS ord, (l_partkey % 30)::INT AS width, (l_quantity)::INT AS height, ((l_partkey % 30) * l_quantity * l_discount * 10)::INT AS area, 40000 AS image_area FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, ord) AS r FROM k WHERE area <= 0.02 * image_area AND height >= 3 AND width >= 2 AND width::DOUBLE / height BETWEEN 0.15 AND 6 AND area::DOUBLE / (width * height) >= 0.15)
SELECT i.id, coalesce(m, 0.0) AS char_height FROM (SELECT DISTINCT id FROM k) i LEFT JOIN (SELECT id, median(height)::DOUBLE AS m FROM o WHERE r <= 200 GROUP BY id) USING (id)
""")
def char_height_median(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "lineitem").select(
        c("l_suppkey").alias("id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"), (c("l_partkey") % 30).cast("int").alias("width"), c("l_quantity").cast("int").alias("height"),
        F.bround((c("l_partkey") % 30) * c("l_quantity") * c("l_discount") * 10).cast("int").alias("area"),
    )
    height = _of_image("double", lambda x: kernels.median_height(*x[:, 1:].T, 40_000))
    return _parts(rows, "width", "height", "area").select("id", height("parts").alias("char_height"))


@query("""
WITH k AS (SELECT l_orderkey AS id, l_linenumber * 100000 + l_partkey AS ord, (l_partkey % 300)::INT AS x, (l_suppkey % 200)::INT AS y, (20 + l_partkey % 600)::INT AS w, (20 + l_quantity * 8)::INT AS h, floor((20 + l_partkey % 600) * floor(20 + l_quantity * 8) * (1 - l_discount))::BIGINT AS area, 1000 AS iw, 700 AS ih FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY area DESC, ord) AS r, greatest(w, h)::DOUBLE / greatest(least(w, h), 1) AS a, area::DOUBLE / (iw * ih) AS f FROM k),
s AS (SELECT *, list_max(list_transform([1.42, 0.70, 1.58, 1.0, 0.63], lambda q: 1.0 / (1.0 + abs(a - q::DOUBLE)))) * (area::DOUBLE / greatest(w * h, 1)) * least(f / 0.10, 1.0) AS v FROM r WHERE r <= 15 AND f BETWEEN 0.03 AND 0.85 AND w >= iw * 0.1 AND h >= ih * 0.1),
b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, r) AS n FROM s)
SELECT id, greatest(0, x - floor(w * 0.02)::INT) AS x1, greatest(0, y - floor(h * 0.02)::INT) AS y1, least(iw, x + w + floor(w * 0.02)::INT) AS x2, least(ih, y + h + floor(h * 0.02)::INT) AS y2, round(v, 6) AS crop_score FROM b WHERE n = 1 AND v >= 0.40
""")
def crop_scoring(spark, sf_dir):
    c = F.col
    w, h = (20 + c("l_partkey") % 600).cast("int"), F.floor(20 + c("l_quantity") * 8).cast("int")
    rows = read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("id"), (c("l_linenumber") * 100000 + c("l_partkey")).alias("ord"), (c("l_partkey") % 300).cast("int").alias("x"), (c("l_suppkey") % 200).cast("int").alias("y"), w.alias("w"), h.alias("h"),
        F.floor(w * h * (1 - c("l_discount"))).alias("area"),
    )
    best = _of_image("array<double>", lambda x: kernels.best_crop(x[:, 1:5], x[:, 5], 1000, 700))
    found = _parts(rows, "x", "y", "w", "h", "area").select("id", best("parts").alias("b")).where("b IS NOT NULL")
    return found.select("id", *[c("b")[k].cast("int").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))], F.round(c("b")[4], 6).alias("crop_score"))


@query("""
WITH k AS (SELECT l_orderkey AS id, l_quantity AS x1, l_discount * 100 AS y1, l_partkey % 1000 AS x2, l_quantity AS y2 FROM lineitem),
a AS (SELECT id, median(degrees(atan2(y2 - y1, x2 - x1))) AS a FROM k WHERE x2 <> x1 AND abs(degrees(atan2(y2 - y1, x2 - x1))) < 15 GROUP BY id)
SELECT i.id, round(CASE WHEN abs(a) >= 0.3 THEN a ELSE 0 END, 6) AS angle FROM (SELECT DISTINCT id FROM k) i LEFT JOIN a USING (id)
""")
def deskew_angle(spark, sf_dir):
    c = F.col
    rows = read(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("id"), c("l_linenumber").alias("ord"), c("l_quantity").alias("x1"), (c("l_discount") * 100).alias("y1"), (c("l_partkey") % 1000).alias("x2"), c("l_quantity").alias("y2"),
    )
    angle = _of_image("double", lambda x: kernels.median_angle(x[:, 1:]))
    return _parts(rows, "x1", "y1", "x2", "y2").select("id", F.round(angle("parts"), 6).alias("angle"))


@query("""
WITH k AS (SELECT p_partkey, (300 + p_partkey % 2500)::INT AS w, (200 + p_partkey * 3 % 1900)::INT AS h FROM part), s AS (SELECT *, CASE WHEN w < 1200 THEN 1200.0::DOUBLE / w WHEN w > 1600 THEN 1600.0::DOUBLE / w ELSE 1.0 END AS f FROM k)
SELECT p_partkey, trunc(w * f)::INT AS new_w, trunc(h * f)::INT AS new_h FROM s
""")
def resize_dims(spark, sf_dir):
    k = F.col("p_partkey")
    size = _of_image("array<int>", lambda x: kernels.target_size(int(x[0]), int(x[1]), 1200, 1600))(F.array((300 + k % 2500).cast("int"), (200 + k * 3 % 1900).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", size.alias("size")).select("p_partkey", F.col("size")[0].alias("new_w"), F.col("size")[1].alias("new_h"))


@query("""
WITH k AS (SELECT p_partkey, (300 + p_partkey % 2500)::INT AS w, (200 + p_partkey * 3 % 1900)::INT AS h FROM part), s AS (SELECT *, 960.0::DOUBLE / greatest(w, h) AS f FROM k)
SELECT p_partkey, CASE WHEN f < 1 THEN greatest(1, trunc(w * f)) ELSE w END::INT AS new_w, CASE WHEN f < 1 THEN greatest(1, trunc(h * f)) ELSE h END::INT AS new_h FROM s
""")
def fitted_dims(spark, sf_dir):
    k = F.col("p_partkey")
    size = _of_image("array<int>", lambda x: kernels.fitted_size(int(x[0]), int(x[1]), 960))(F.array((300 + k % 2500).cast("int"), (200 + k * 3 % 1900).cast("int")))
    return read(spark, sf_dir, "part").select("p_partkey", size.alias("size")).select("p_partkey", F.col("size")[0].alias("new_w"), F.col("size")[1].alias("new_h"))


_LISTS = "pl AS (SELECT vec_id AS id, list_transform(embedding, lambda e: floor((e::DOUBLE + 1) * 127.5)::INT) AS l FROM embeddings)"


def _levels(spark, sf_dir, rule: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """(id, pos, level) of planes after a rule, row by row."""
    out = _of_image("array<int>", lambda x: rule(_plane(x)).ravel().astype(np.int32))("plane")
    return _planes(spark, sf_dir).select("id", F.posexplode(out).alias("pos", "level"))


def _blurred(source: str, target: str, sigma: float, radius: int) -> str:
    """CTEs of a Gaussian blur over lists of 8 x 8, columns first, borders reflected; weights are written out in full."""
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    w = [repr(float(v)) + "::DOUBLE" for v in w / w.sum()]
    place = lambda k: f"(7 - abs(7 - abs({k})))"
    down = " + ".join(f"{v} * l[1 + {place(f'p // 8 + {d}')} * 8 + p % 8]" for v, d in zip(w, range(-radius, radius + 1), strict=True))
    across = " + ".join(f"{v} * l[1 + p // 8 * 8 + {place(f'p % 8 + {d}')}]" for v, d in zip(w, range(-radius, radius + 1), strict=True))
    return f"""{target}_v AS (SELECT id, list_transform(range(0, 64), lambda p: {down}) AS l FROM {source}),
{target} AS (SELECT id, list_transform(range(0, 64), lambda p: round_even({across}, 0)::INT) AS l FROM {target}_v)"""


@query(f"WITH {_LISTS}, {_blurred('pl', 'bl', 0.8, 1)} SELECT id, (i - 1)::INT AS pos, l[i] AS level FROM bl, unnest(range(1, 65)) AS u(i)")
def denoise(spark, sf_dir):
    return _levels(spark, sf_dir, kernels.denoise)


@query(f"""WITH {_LISTS}, {_blurred('pl', 'bl', 1.0, 3)}
SELECT id, (i - 1)::INT AS pos, least(255, greatest(0, round_even(pl.l[i] * 2.5::DOUBLE - bl.l[i] * 1.5::DOUBLE, 0)))::INT AS level FROM pl JOIN bl USING (id), unnest(range(1, 65)) AS u(i)""")
def unsharp_mask(spark, sf_dir):
    return _levels(spark, sf_dir, kernels.unsharp)


@query(f"""WITH {_LISTS} SELECT id, p::INT AS pos, round_even((l[1 + (p // 4) * 16 + (p % 4) * 2] + l[2 + (p // 4) * 16 + (p % 4) * 2] + l[9 + (p // 4) * 16 + (p % 4) * 2] + l[10 + (p // 4) * 16 + (p % 4) * 2]) / 4.0::DOUBLE, 0)::INT AS level
FROM pl, unnest(range(0, 16)) AS u(p)""")
def shrunk_pixels(spark, sf_dir):
    return _levels(spark, sf_dir, lambda x: kernels.resize(x[..., None], 4, 4))


@query(f"""WITH {_LISTS}, o AS (SELECT id, (1 + id % 8)::INT AS how, l, CASE WHEN id % 8 < 4 THEN 4 ELSE 16 END AS high FROM pl),
p AS (SELECT id, how, l, p, p // (64 // high) AS y, p % (64 // high) AS x FROM o, unnest(range(0, 64)) AS u(p))
SELECT id, how, p::INT AS pos, l[1 + CASE how WHEN 1 THEN y * 16 + x WHEN 2 THEN y * 16 + 15 - x WHEN 3 THEN (3 - y) * 16 + 15 - x WHEN 4 THEN (3 - y) * 16 + x
  WHEN 5 THEN x * 16 + y WHEN 6 THEN (3 - x) * 16 + y WHEN 7 THEN (3 - x) * 16 + 15 - y ELSE x * 16 + 15 - y END] AS level FROM p""")
def upright_pixels(spark, sf_dir):
    """Planes of 4 x 16, turned as each of the eight orientations says."""
    @F.pandas_udf("array<int>")
    def turned(how: pd.Series, plane: pd.Series) -> pd.Series:
        return pd.Series([kernels.upright(np.repeat(np.asarray(p).reshape(4, 16, 1), 3, axis=2), h)[..., 0].ravel() for h, p in zip(how, plane, strict=True)])

    rows = _planes(spark, sf_dir).withColumn("how", (1 + F.col("id") % 8).cast("int"))
    return rows.select("id", "how", F.posexplode(turned("how", "plane")).alias("pos", "level"))


def _at(dy: int, dx: int) -> str:
    return f"l[1 + least(7, greatest(0, p // 8 + {dy})) * 8 + least(7, greatest(0, p % 8 + {dx}))]"


_EDGES = f"""{_LISTS},
gr AS (SELECT id, p // 8 AS y, p % 8 AS x, {_at(-1, 1)} + 2 * {_at(0, 1)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(0, -1)} - {_at(1, -1)} AS gx,
  {_at(1, -1)} + 2 * {_at(1, 0)} + {_at(1, 1)} - {_at(-1, -1)} - 2 * {_at(-1, 0)} - {_at(-1, 1)} AS gy FROM pl, unnest(range(0, 64)) AS u(p)),
mg AS (SELECT *, abs(gx) + abs(gy) AS m, CASE WHEN abs(gy) <= abs(gx) * {float(np.tan(np.pi / 8))!r}::DOUBLE THEN 0 WHEN abs(gy) >= abs(gx) * {float(np.tan(3 * np.pi / 8))!r}::DOUBLE THEN 1 WHEN gx * gy > 0 THEN 2 ELSE 3 END AS way FROM gr),
th AS (SELECT a.id, a.y, a.x, a.m FROM mg a LEFT JOIN mg b ON b.id = a.id AND b.y = a.y + ([0, -1, -1, -1])[1 + a.way] AND b.x = a.x + ([-1, 0, -1, 1])[1 + a.way]
  LEFT JOIN mg c ON c.id = a.id AND c.y = a.y + ([0, 1, 1, 1])[1 + a.way] AND c.x = a.x + ([1, 0, 1, -1])[1 + a.way] WHERE a.m > coalesce(b.m, 0) AND a.m >= coalesce(c.m, 0) AND a.m > 60),
ed(id, y, x) AS (SELECT id, y, x FROM th WHERE m > 160 UNION SELECT t.id, t.y, t.x FROM ed e JOIN th t ON t.id = e.id AND t.y BETWEEN e.y - 1 AND e.y + 1 AND t.x BETWEEN e.x - 1 AND e.x + 1)"""


@query(f"WITH RECURSIVE {_EDGES} SELECT DISTINCT id, y + dy AS y, x + dx AS x FROM ed, (VALUES (-1), (0), (1)) AS a(dy), (VALUES (-1), (0), (1)) AS b(dx) WHERE y + dy BETWEEN 0 AND 7 AND x + dx BETWEEN 0 AND 7")
def text_mask(spark, sf_dir):
    """Pixels of the text mask: edges, followed from strong to weak ones, then widened."""
    rows = _levels(spark, sf_dir, kernels.text_mask).where("level <> 0")
    return rows.select("id", F.floor(F.col("pos") / 8).alias("y"), (F.col("pos") % 8).cast("long").alias("x"))


@query(f"""WITH {_PIXELS}, g AS (SELECT id, pos // 8 AS y, pos % 8 AS x, level FROM x),
n AS (SELECT a.id, a.x, a.y, any_value(a.level) AS level, sum(b.level * (CASE WHEN abs(dx) + abs(dy) = 0 THEN -4 ELSE 1 END)) AS l FROM g a, (VALUES (0, 0), (1, 0), (-1, 0), (0, 1), (0, -1)) AS d(dx, dy)
  JOIN g b ON b.id = a.id AND b.x = CASE WHEN a.x + dx < 0 THEN 1 WHEN a.x + dx > 7 THEN 6 ELSE a.x + dx END AND b.y = CASE WHEN a.y + dy < 0 THEN 1 WHEN a.y + dy > 7 THEN 6 ELSE a.y + dy END GROUP BY a.id, a.x, a.y)
SELECT id, CASE WHEN count(*) FILTER (level > 134) >= 20 THEN round(var_pop(l) FILTER (level > 134) * 4096) ELSE 0 END::BIGINT AS sharpness_4096 FROM n GROUP BY id""")
def masked_sharpness(spark, sf_dir):
    """Sharpness on a mask, here of the brighter pixels; 0 where it has fewer than 20."""
    variance = _of_image("double", lambda x: kernels.sharpness(_plane(x), _plane(x) > 134))("plane")
    return _planes(spark, sf_dir).select("id", F.round(variance * 4096).cast("long").alias("sharpness_4096"))


def _bgr(plus: tuple[int, int, int]):
    """Blue, green and red bytes of embeddings: each channel is the vector, turned by 2, 1 or 0."""
    def byte(k: int, base: int):
        return F.transform("embedding", lambda e, i: F.least(F.lit(255), F.greatest(F.lit(0), F.floor(F.get("embedding", (i + k) % 64).cast("double") * 900 + base))).cast("int"))

    return F.array(byte(2, plus[0]), byte(1, plus[1]), byte(0, plus[2]))


@query("""
WITH r AS (SELECT vec_id AS id, i - 1 AS pos, least(255, greatest(0, floor(embedding[i]::DOUBLE * 900 + 60)))::INT AS r, least(255, greatest(0, floor(embedding[1 + i % 64]::DOUBLE * 900 + 90)))::INT AS g, least(255, greatest(0, floor(embedding[1 + (i + 1) % 64]::DOUBLE * 900 + 150)))::INT AS b
  FROM embeddings, unnest(range(1, 65)) AS u(i)),
m AS (SELECT *, greatest(r, g, b) AS v, least(r, g, b) AS k FROM r),
h AS (SELECT *, CASE WHEN v > 0 THEN round_even(255 * (v - k)::DOUBLE / v, 0) ELSE 0 END AS s,
  CASE WHEN v = k THEN 0 WHEN v = r THEN (g - b)::DOUBLE / (v - k) + CASE WHEN g < b THEN 6 ELSE 0 END WHEN v = g THEN (b - r)::DOUBLE / (v - k) + 2 ELSE (r - g)::DOUBLE / (v - k) + 4 END AS t FROM m)
SELECT id, pos::INT AS pos, CASE WHEN (round_even(t * 30, 0)::INT % 180) BETWEEN 80 AND 130 AND s >= 50 AND v >= 50 THEN 0 ELSE 255 END AS key_level, CASE WHEN v <= 90 THEN 0 ELSE 255 END AS value_level FROM h
""")
def colour_masks(spark, sf_dir):
    """What is blue and what is dark, as black on white."""
    def both(x: np.ndarray) -> np.ndarray:
        keys, values = kernels.colour_masks(x.T.reshape(8, 8, 3).astype(np.uint8))
        return (keys[..., 0].astype(np.int32) * 256 + values[..., 0]).ravel()

    rows = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.posexplode(_of_image("array<int>", both)(_bgr((150, 90, 60)))).alias("pos", "two"))
    return rows.select("id", "pos", F.floor(F.col("two") / 256).cast("int").alias("key_level"), (F.col("two") % 256).alias("value_level"))


# ---------------------------------------------------------------- results and sources


def _results(spark, sf_dir):
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(
        F.concat(F.lit("img"), F.lpad(k.cast("string"), 6, "0"), F.lit(".png")).alias("image"), F.when(k % 3 == 0, "SUCCESS").when(k % 3 == 1, "FAILED").otherwise("ERROR: x").alias("status"),
        F.when(k % 2 == 0, letters(k)).alias("nom"), F.when(k % 3 == 1, letters(k)).alias("prenom"), F.lit(None).cast("string").alias("adresse"),
    )


_RESULTS = f"""r AS (SELECT 'img' || lpad(c_custkey::VARCHAR, 6, '0') || '.png' AS image, CASE c_custkey % 3 WHEN 0 THEN 'SUCCESS' WHEN 1 THEN 'FAILED' ELSE 'ERROR: x' END AS status,
  CASE WHEN c_custkey % 2 = 0 THEN {LETTERS_SQL.format('c_custkey')} END AS nom, CASE WHEN c_custkey % 3 = 1 THEN {LETTERS_SQL.format('c_custkey')} END AS prenom FROM customer)"""


@query(f"WITH {_RESULTS} SELECT image, status, CASE WHEN status = 'SUCCESS' THEN nom END AS nom, row_number() OVER (ORDER BY status <> 'SUCCESS', image) AS line FROM r")
def result_union_ordered(spark, sf_dir):
    """Order made visible by a line number."""
    r = _results(spark, sf_dir).select("image", "status", "nom")
    rows = sinks.union_rows(r.where("status = 'SUCCESS'"), r.where("status <> 'SUCCESS'").drop("nom"))
    return sinks.number_lines(rows, sinks.rank(F.col("status")), "image")


@query(f"WITH {_RESULTS} SELECT unnest(['image', 'status', 'nom']) AS name, unnest([1, 2, 3]) AS place WHERE (SELECT count(nom) FILTER (status = 'SUCCESS') > 0 AND count(prenom) FILTER (status = 'SUCCESS') = 0 FROM r)")
def result_columns(spark, sf_dir):
    names = sinks.result_columns(_results(spark, sf_dir))
    return spark.createDataFrame([(n, k) for k, n in enumerate(names, 1)], "name string, place int")


@query(f"""WITH {_RESULTS} SELECT image || ';' || status || ';' || coalesce(CASE WHEN status = 'SUCCESS' THEN nom END, '') AS line, 1 AS n FROM r UNION ALL SELECT 'image;status;nom', 1""")
def csv_lines(spark, sf_dir):
    """Lines of the result file, header included, from the parts that were written; the reader skips the mark."""
    folder = shared.mounted(shared.shared_folder(spark, "csv"))
    sinks.write_csv(_results(spark, sf_dir), folder)
    lines = spark.read.option("lineSep", "\r\n").text(f"file://{folder}/part-*.csv")
    return lines.groupBy(F.col("value").alias("line")).agg(F.count(F.lit(1)).cast("int").alias("n"))


@query(f"WITH {_RESULTS} SELECT CASE WHEN status = 'SUCCESS' THEN 'SUCCESS' ELSE 'FAILED' END AS outcome, count(*) AS n FROM r GROUP BY 1")
def status_counts(spark, sf_dir):
    return sinks.status_counts(_results(spark, sf_dir))


_PATHS = "p AS (SELECT page_id, url || (['.png', '.JPG', '.txt', '', '.tif', '.jpeg.gz'])[1 + page_id % 6] AS path FROM pages)"


def _paths(spark, sf_dir):
    end = F.element_at(F.array(*map(F.lit, (".png", ".JPG", ".txt", "", ".tif", ".jpeg.gz"))), (1 + F.col("page_id") % 6).cast("int"))
    return read(spark, sf_dir, "pages").select("page_id", F.concat("url", end).alias("path"))


@query(f"WITH {_PATHS} SELECT page_id, path, list_last(string_split(path, '/')) AS name FROM p WHERE regexp_matches(lower(path), '\\.(jpg|jpeg|png|bmp|tif|tiff|gif)$')")
def path_filter(spark, sf_dir):
    return _paths(spark, sf_dir).where(images.is_image(F.col("path"))).select("page_id", "path", gates.base_name(F.col("path")).alias("name"))


@query(f"WITH {_PATHS} SELECT page_id, path, path IN (SELECT path FROM p WHERE page_id % 4 = 0) AS there FROM p")
def path_semi_anti(spark, sf_dir):
    p = _paths(spark, sf_dir)
    known = p.where("page_id % 4 = 0").select("path").distinct()
    there, gone = p.join(known, "path", "left_semi"), p.join(known, "path", "left_anti")
    return there.withColumn("there", F.lit(True)).unionByName(gone.withColumn("there", F.lit(False))).select("page_id", "path", "there")


@query("""SELECT s_suppkey, CASE s_suppkey % 3 WHEN 2 THEN 'db' || s_suppkey ELSE 'db' || s_suppkey END AS file,
  CASE WHEN s_suppkey % 3 = 0 THEN '/abs/' || s_suppkey WHEN s_suppkey % 3 = 1 THEN '/data/x' || s_suppkey ELSE 'x' || s_suppkey END AS path FROM supplier""")
def sqlite_paths(spark, sf_dir):
    k = F.col("s_suppkey").cast("string")
    kind = F.col("s_suppkey") % 3
    url = F.concat(F.when(kind == 0, "sqlite:///").when(kind == 1, "sqlite://").otherwise(""), F.lit("db"), k)
    path = F.when(kind == 0, F.concat(F.lit("/abs/"), k)).otherwise(F.concat(F.lit("x"), k))
    return read(spark, sf_dir, "supplier").select("s_suppkey", images.sqlite_path(url).alias("file"), images.resolve_path(path, "/data/", kind == 1).alias("path"))


@query("""
WITH a AS (SELECT s_suppkey, CASE s_suppkey % 6 WHEN 0 THEN ' scan' || s_suppkey || '.png ' WHEN 1 THEN './sub//scan' || s_suppkey || '.png' WHEN 2 THEN '/archive/scan' || s_suppkey || '.png' WHEN 3 THEN NULL WHEN 4 THEN ' ' ELSE 'gone' || s_suppkey || '.png' END AS path
  FROM supplier, range(0, 2) AS twice)
SELECT CASE s_suppkey % 6 WHEN 0 THEN 'beside/scan' || s_suppkey || '.png' WHEN 1 THEN 'beside/sub/scan' || s_suppkey || '.png' ELSE path END AS path, count(*) AS n FROM a WHERE s_suppkey % 6 < 3 AND s_suppkey % 5 <> 0 GROUP BY s_suppkey, path
""")
def sqlite_image_list(spark, sf_dir):
    """A list in databases, one a task, made from suppliers: twice each, blanks, nulls, paths of three kinds, some files missing."""
    k = F.col("s_suppkey").cast("string")
    kind, end = F.col("s_suppkey") % 6, F.concat(F.lit("scan"), k, F.lit(".png"))
    path = (
        F.when(kind == 0, F.concat(F.lit(" "), end, F.lit(" "))).when(kind == 1, F.concat(F.lit("./sub//"), end)).when(kind == 2, F.concat(F.lit("/archive/"), end))
        .when(kind == 3, None).when(kind == 4, " ").otherwise(F.concat(F.lit("gone"), k, F.lit(".png")))
    )
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("twice"))
    folder = shared.mounted(shared.shared_folder(spark, "image-lists"))
    made = [r.database for r in sqlite.write_databases(rows.select(path.alias("path")), folder).collect()]
    there = read(spark, sf_dir, "supplier").where((kind < 3) & (F.col("s_suppkey") % 5 != 0)).select(
        F.concat(F.when(kind == 2, "/archive/").when(kind == 1, folder + "/sub/").otherwise(folder + "/"), end).alias("path")
    )
    found = sqlite.images_from_sqlite(spark, made, listing=there)
    return found.groupBy(F.regexp_replace("path", "^" + re.escape(folder), "beside").alias("path")).agg(F.count(F.lit(1)).alias("n"))
