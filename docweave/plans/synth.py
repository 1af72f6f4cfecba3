"""Documents made from the star-schema tables, for queries whose results follow from those tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Letters for digits, so that made-up names resemble no label.
LETTERS = "translate(lpad(CAST({0} AS STRING), 8, '0'), '0123456789', 'BCDFGHJKLQ')"

#: (doc_id, ord, text, x, y): by key, label and value side by side, in one token, values below labels, or a zone.
#: In one token, only labels are used that the raw keyword begins with. Every tenth has no document number; every tenth has a birth label without a value.
TOKEN_SQL = """
WITH p AS (
  SELECT c_custkey AS k, c_custkey % 4 AS style, c_custkey % 10 = 9 AS no_number, c_custkey % 10 = 8 AS no_birth,
    {surname} AS surname, {given} AS given, {nation} AS nation,
    element_at(array('FRA', 'DEU', 'USA', 'ITA', 'ZZQ', 'GBR'), CAST(1 + n_nationkey % 6 AS INT)) AS code, concat('PX', lpad(CAST(c_custkey AS STRING), 7, '0')) AS number,
    lpad(CAST(1 + c_custkey % 28 AS STRING), 2, '0') AS dd, lpad(CAST(1 + c_custkey % 12 AS STRING), 2, '0') AS mm, CAST(1950 + c_custkey % 50 AS STRING) AS yyyy,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), f AS (
  SELECT k, style, no_number, no_birth, posexplode(array(
    named_struct('l', CASE k % 3 WHEN 0 THEN 'Nom' WHEN 1 THEN 'Surname' ELSE 'Nachname' END, 'v', surname),
    named_struct('l', CASE WHEN k % 3 = 0 THEN 'Prenom' WHEN k % 3 = 1 AND style <> 1 THEN 'Given name' ELSE 'Vorname' END, 'v', given),
    named_struct('l', CASE WHEN k % 3 = 1 AND style <> 1 THEN 'Nationalité' WHEN k % 3 = 2 THEN 'Nationalität' ELSE 'Nationality' END, 'v', nation),
    named_struct('l', CASE k % 2 WHEN 0 THEN 'Passport No' ELSE 'Document number' END, 'v', CASE WHEN no_number THEN '' ELSE number END),
    named_struct('l', CASE k % 2 WHEN 0 THEN 'Date of birth' ELSE 'Geburtsdatum' END, 'v', CASE WHEN no_birth THEN '' ELSE concat_ws('.', dd, mm, yyyy) END),
    named_struct('l', CASE k % 2 WHEN 0 THEN 'Sex' ELSE 'Sexe' END, 'v', sex)
  )) AS (i, e) FROM p
)
SELECT k AS doc_id, 2 * i AS ord, e.l AS text, 100.0 AS x, 100.0 + 40 * i + (k % 7) AS y FROM f WHERE style = 0
UNION ALL SELECT k, 2 * i + 1, e.v, 300.0, 100.0 + 40 * i FROM f WHERE style = 0 AND e.v <> ''
UNION ALL SELECT k, i, CASE WHEN e.v = '' THEN e.l ELSE concat(e.l, ': ', e.v) END, 100.0 + (k % 13), 100.0 + 40 * i FROM f WHERE style = 1
UNION ALL SELECT k, i, e.l, 100.0 + 200 * (i % 3), 100.0 + 100 * CAST(floor(i / 3) AS INT) FROM f WHERE style = 2
UNION ALL SELECT k, 10 + i, e.v, 110.0 + 200 * (i % 3) - (k % 9), 140.0 + 100 * CAST(floor(i / 3) AS INT) FROM f WHERE style = 2 AND e.v <> ''
UNION ALL SELECT k, 0, rpad(concat('P<', code, surname, '<<', given), 44, '<'), 50.0, 500.0 FROM p WHERE style = 3
UNION ALL SELECT k, 1, rpad(concat(number, '7', code, substr(yyyy, 3, 2), mm, dd, '1', sex, '3001019'), 44, '<'), 50.0, 540.0 FROM p WHERE style = 3 AND NOT no_number
"""

#: What must be found in these documents, as DuckDB SQL.
EXPECTED_SQL = """
WITH p AS (
  SELECT c_custkey AS k, c_custkey % 4 AS style, c_custkey % 10 = 9 AS no_number, c_custkey % 10 = 8 AS no_birth,
    translate(lpad(c_custkey::VARCHAR, 8, '0'), '0123456789', 'BCDFGHJKLQ') AS surname, translate(lpad((c_custkey * 7919 % 100000000)::VARCHAR, 8, '0'), '0123456789', 'BCDFGHJKLQ') AS given,
    translate(lpad(n_nationkey::VARCHAR, 8, '0'), '0123456789', 'BCDFGHJKLQ') AS nation, (['FRA', 'DEU', 'USA', 'ITA', 'ZZQ', 'GBR'])[1 + n_nationkey % 6] AS code, 'PX' || lpad(c_custkey::VARCHAR, 7, '0') AS number,
    lpad((1 + c_custkey % 28)::VARCHAR, 2, '0') || '/' || lpad((1 + c_custkey % 12)::VARCHAR, 2, '0') || '/' AS dm, (1950 + c_custkey % 50)::VARCHAR AS yyyy,
    CASE WHEN c_custkey % 2 = 0 THEN 'M' ELSE 'F' END AS sex
  FROM customer JOIN nation ON c_nationkey = n_nationkey
), v AS (
  SELECT k, style, no_number, no_birth, style = 3 AND no_number AS zone_cut, surname, given, nation, code, number, dm, yyyy, sex FROM p
)
SELECT k AS doc_id,
  CASE WHEN no_number OR (no_birth AND style <> 3) THEN 'FAILED' ELSE 'SUCCESS' END AS status,
  CASE WHEN no_number OR (no_birth AND style <> 3) THEN 'REJECTED_UNCLEAR_KEYS' END AS failure_code,
  surname AS nom, CASE WHEN style = 3 THEN upper(given[1]) || lower(given[2:]) ELSE given END AS prenom,
  CASE WHEN (no_birth AND style <> 3) OR zone_cut THEN NULL
    ELSE dm || CASE WHEN style = 3 THEN (CASE WHEN yyyy[3:4]::INT > 26 THEN '19' ELSE '20' END) || yyyy[3:4] ELSE yyyy END END AS date_naissance,
  CASE WHEN style = 3 THEN coalesce(map {countries}[code], code) ELSE nation END AS nationalite,
  CASE WHEN no_number THEN NULL ELSE number END AS numero_document,
  CASE WHEN style = 3 AND NOT no_number THEN '01/01/2030' END AS date_expiration,
  CASE WHEN zone_cut THEN NULL ELSE sex END AS sexe,
  NULL::VARCHAR AS lieu_naissance, NULL::VARCHAR AS date_delivrance, NULL::VARCHAR AS adresse
FROM v
"""


def identity_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of one identity document per customer, in the schema of schemas.TOKENS."""
    sql = TOKEN_SQL.format(surname=LETTERS.format("c_custkey"), given=LETTERS.format("c_custkey * 7919 % 100000000"), nation=LETTERS.format("n_nationkey"))
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("customer", "nation")}
    sql = sql.replace("FROM customer JOIN nation", "FROM {customer} JOIN {nation}")
    made = spark.sql(sql, **tables)
    return made.selectExpr(
        "doc_id", "CAST(ord AS INT) AS ord", "text", "CAST(0.9 AS DOUBLE) AS confidence",
        "array(array(double(x), double(y)), array(double(x + 60), double(y)), array(double(x + 60), double(y + 20)), array(double(x), double(y + 20))) AS box", "'unknown' AS type",
    )
