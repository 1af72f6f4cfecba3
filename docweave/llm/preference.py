"""Preference formatting of paired conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docweave.llm.common import join_by_hot_key, materialize

#: Rendering of a turn: head, text, tail. The head names the role.
HEAD, MID, TAIL = "<|im_start|>", "\n", "<|im_end|>\n"
LEARNT_ROLE = "assistant"


def paired_turns(conversations: DataFrame) -> DataFrame:
    """Pairs that share all but an answer: pair k is conversation k against itself with another's last answer.

    The rejected side has the last assistant turn of conversation k replaced by that of its neighbour, k + 1 for an even
    k and k - 1 for an odd one. Without such a neighbour, the rejected side lacks the turn; a conversation without an
    assistant turn is the same on both sides. The last assistant turn is that with the highest number (a null number
    is the highest), and of equal numbers the last by text.
    """
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("pair_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    at = F.struct(F.col("turn").isNull().alias("z"), "turn", "text")
    last = materialize(
        rows.groupBy("pair_id").agg(F.max(F.when(F.col("role") == LEARNT_ROLE, at)).alias("last"), F.count(F.lit(1)).alias("n")), "last-answers"
    )
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1)).alias("pair_id"), F.col("last.text").alias("instead"), F.col("last").isNotNull().alias("has"))
    facts = last.join(other, "pair_id", "left").select("pair_id", "n", "last", "instead", F.coalesce("has", F.lit(False)).alias("has"))
    total = last.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = join_by_hot_key(rows, facts, "pair_id", "n", total)
    replaced = (F.col("role") == LEARNT_ROLE) & F.col("turn").eqNullSafe(F.col("last.turn")) & (F.col("text") == F.col("last.text"))
    side = lambda name, text: F.struct(F.lit(name).alias("side"), text.alias("text"))
    rejected = F.when(~replaced, F.col("text")).when(F.col("has"), F.col("instead"))
    sides = F.filter(F.array(side("chosen", F.col("text")), side("rejected", rejected)), lambda x: x["text"].isNotNull())
    return known.withColumn("s", F.explode(sides)).select("pair_id", "s.side", "turn", "role", "s.text")


def format_preferences(turns: DataFrame) -> DataFrame:
    """Render pairs of conversations: the longest common turn prefix once as prompt, then both masked completions.

    turns: pair_id, side ('chosen' or 'rejected'), turn, role, text. Returns one row per rendered turn: pair_id, part
    ('prompt', 'chosen', 'rejected'), turn, k (order among different rows with the same turn number), role, text
    (rendered), loss_start and loss_end (characters of ``text`` a model learns from: what an assistant says in a
    completion and the end mark after it; both 0 for masked turns), prompt_turns, pair_turns. A part's string is the
    concatenation of its rows by (turn, k).

    Turns are compared by turn number, k, role and text. The prefix ends before the first turn that one side lacks or
    words otherwise; so a side that is missing leaves no prompt, and sides that are equal are prompt only. Null role
    and text count as empty, a null turn number comes last; rows repeated within a side count once, different rows
    with the same turn number follow each other by role, then text. Rows without pair_id belong to no pair and are
    left out. Extra columns are not read. The result stays by turn, so a conversation of any length is never one value;
    :func:`assemble` makes strings where conversations are known to be short.
    """
    body = turns.where(F.col("pair_id").isNotNull()).select(
        "pair_id", "side", F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    # one shuffle, by pair and turn: it serves the order of equal turn numbers and the comparison of both sides
    here = Window.partitionBy("pair_id", "turn", "side").orderBy("role", "text")
    said = F.struct("role", "text")
    ranked = (
        body.repartition("pair_id", "turn")
        .withColumn("rank", F.dense_rank().over(here))
        .withColumn("again", F.lag(said).over(here).eqNullSafe(said))
        .where(~F.col("again"))
    )
    both = ranked.groupBy("pair_id", "turn", "rank").agg(
        F.max(F.when(F.col("side") == "chosen", said)).alias("chosen"), F.max(F.when(F.col("side") == "rejected", said)).alias("rejected")
    )
    both = materialize(both, "paired-turns")
    at = F.struct(F.col("turn").isNull().alias("z"), "turn", "rank")
    pairs = materialize(
        both.groupBy("pair_id").agg(
            F.min(F.when(~F.col("chosen").eqNullSafe(F.col("rejected")), at)).alias("split"),
            F.count(F.lit(1)).alias("pair_turns"),
        ), "pairs",
    )
    total = pairs.agg(F.coalesce(F.sum("pair_turns"), F.lit(0))).first()[0]
    rows = join_by_hot_key(both, pairs, "pair_id", "pair_turns", total)
    common = F.col("split").isNull() | (at < F.col("split"))
    parts = F.when(common, F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("said")))).otherwise(
        F.filter(
            F.array(F.struct(F.lit("chosen").alias("part"), F.col("chosen").alias("said")), F.struct(F.lit("rejected").alias("part"), F.col("rejected").alias("said"))),
            lambda p: p["said"].isNotNull(),
        )
    )
    out = rows.withColumn("p", F.explode(parts)).select(
        "pair_id", "p.part", "turn", F.col("rank").alias("k"), "p.said.role", F.col("p.said.text").alias("raw"), "split", "pair_turns",
    )
    head = F.concat(F.lit(HEAD), F.col("role"), F.lit(MID))
    learnt = (F.col("part") != "prompt") & (F.col("role") == LEARNT_ROLE)
    return out.select(
        "pair_id", "part", "turn", "k", "role",
        F.concat(head, "raw", F.lit(TAIL)).alias("text"),
        F.when(learnt, F.length(head)).otherwise(0).cast("long").alias("loss_start"),
        F.when(learnt, F.length(head) + F.length("raw") + len(TAIL)).otherwise(0).cast("long").alias("loss_end"),
        F.col("pair_turns").cast("long").alias("pair_turns"),
    )


def assemble(segments: DataFrame) -> DataFrame:
    """One row per pair: prompt, chosen, rejected strings, and per completion the learnt character spans.

    For conversations that fit into one value; each pair is gathered in one task.
    """
    piece = F.struct(F.col("turn").isNull().alias("z"), "turn", "k", "text", "loss_start", "loss_end")
    held = segments.groupBy("pair_id").agg(*[
        F.array_sort(F.collect_list(F.when(F.col("part") == p, piece))).alias(p) for p in ("prompt", "chosen", "rejected")
    ])
    join = lambda c: F.array_join(F.transform(c, lambda x: x["text"]), "")

    def spans(c):
        walk = F.aggregate(
            c, F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS ARRAY<STRUCT<s: INT, e: INT>>)").alias("out")),
            lambda acc, x: F.struct(
                (acc["at"] + F.length(x["text"])).alias("at"),
                F.when(x["loss_end"] > 0, F.concat(acc["out"], F.array(F.struct((acc["at"] + x["loss_start"]).cast("int").alias("s"), (acc["at"] + x["loss_end"]).cast("int").alias("e"))))).otherwise(acc["out"]).alias("out"),
            ),
        )
        return walk["out"]

    return held.select(
        "pair_id", join("prompt").alias("prompt"), join("chosen").alias("chosen"), join("rejected").alias("rejected"),
        spans(F.col("chosen")).alias("chosen_loss"), spans(F.col("rejected")).alias("rejected_loss"),
    )


def op7(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    return format_preferences(paired_turns(conversations))


OP7_SQL = """
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), a AS (
  SELECT conv_id, turn, text FROM c WHERE role = 'assistant'
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS FIRST, text DESC) = 1
), x AS (
  SELECT c.*, own.conv_id IS NOT NULL AS last, other.text AS instead
  FROM c LEFT JOIN a AS own ON own.conv_id = c.conv_id AND own.turn IS NOT DISTINCT FROM c.turn AND own.text = c.text AND c.role = 'assistant'
  LEFT JOIN a AS other ON other.conv_id = xor(c.conv_id, 1)
), t AS (
  SELECT DISTINCT conv_id AS pair_id, 0 AS side, turn, role, text FROM x
  UNION SELECT DISTINCT conv_id, 1, turn, role, CASE WHEN last THEN instead ELSE text END FROM x WHERE NOT last OR instead IS NOT NULL
), r AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, side, turn ORDER BY role, text) AS k FROM t
), b AS (
  SELECT pair_id, turn, k, max(role) FILTER (side = 0) AS crole, max(text) FILTER (side = 0) AS ctext,
    max(role) FILTER (side = 1) AS rrole, max(text) FILTER (side = 1) AS rtext FROM r GROUP BY pair_id, turn, k
), o AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY turn NULLS LAST, k) AS pos, count(*) OVER (PARTITION BY pair_id) AS pair_turns FROM b
), f AS (
  SELECT *, coalesce(min(pos) FILTER (crole IS DISTINCT FROM rrole OR ctext IS DISTINCT FROM rtext) OVER (PARTITION BY pair_id), 9000000000000000000) AS split FROM o
), e AS (
  SELECT pair_id, 'prompt' AS part, turn, k, crole AS role, ctext AS raw, pair_turns FROM f WHERE pos < split
  UNION ALL SELECT pair_id, 'chosen', turn, k, crole, ctext, pair_turns FROM f WHERE pos >= split AND crole IS NOT NULL
  UNION ALL SELECT pair_id, 'rejected', turn, k, rrole, rtext, pair_turns FROM f WHERE pos >= split AND rrole IS NOT NULL
)
SELECT pair_id, part, turn, k::INT AS k, role, '<|im_start|>' || role || chr(10) || raw || '<|im_end|>' || chr(10) AS text,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 13 + length(role) ELSE 0 END::BIGINT AS loss_start,
  CASE WHEN part <> 'prompt' AND role = 'assistant' THEN 13 + length(role) + length(raw) + 11 ELSE 0 END::BIGINT AS loss_end,
  pair_turns
FROM e
"""
