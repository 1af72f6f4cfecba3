"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docweave.llm import block_norms, exact_dedup, license_scan, lm_mixing, mpeg_audio, packing, pii_crf, preference, quality_cotrain, simhash_trie, source_mix, sp_lattice, whitening
from docweave.llm.common import table


def _over(name: str, query: Callable[[SparkSession, DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(spark, table(spark, sf_dir, name))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pii_crf": _over("documents", pii_crf.op1),
        "op2_lm_mixing": _over("documents", lm_mixing.op2),
        "op3_sp_lattice": _over("documents", sp_lattice.op3),
        "op4_source_mix": _over("documents", source_mix.op4),
        "op5_exact_dedup": _over("documents", exact_dedup.op5),
        "op6_simhash_trie": _over("documents", simhash_trie.op6),
        "op7_preference_format": _over("conversations", preference.op7),
        "op8_packed_ids": _over("documents", packing.op8),
        "op9_mpeg_audio": _over("documents", mpeg_audio.op9),
        "op10_quality_cotrain": quality_cotrain.op10,
        "op11_whitening": _over("embeddings", whitening.op11),
        "op12_block_norms": _over("embeddings", block_norms.op12),
        "op13_license_scan": _over("documents", license_scan.op13),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_source_mix": source_mix.OP4_SQL,
        "op5_exact_dedup": exact_dedup.OP5_SQL,
        "op7_preference_format": preference.OP7_SQL,
        "op12_block_norms": block_norms.OP12_SQL,
    }
