"""Queries over the corpus tables and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cardlens.llm import ann, bpe, crf, decontam, dedup, katz, langid, periodic, rules, shards, toxicity, trie, warc

# name -> (query, DuckDB SQL or None where SQL cannot express it)
REGISTRY: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {
    "op1_near_duplicates": (dedup.op1_near_duplicates, dedup.ORACLE),
    "op2_quality_rules": (rules.op2_quality_rules, rules.ORACLE),
    "op3_quality": (crf.op3_quality, None),
    "op4_toxicity": (toxicity.op4_toxicity, None),
    "op5_byte_shards": (shards.op5_byte_shards, shards.ORACLE),
    "op6_language": (langid.op6_language, None),
    "op7_katz": (katz.op7_katz, None),
    "op8_bpe": (bpe.op8_bpe, None),
    "op9_decontamination": (decontam.op9_decontamination, None),
    "op10_warc": (warc.op10_warc, warc.ORACLE),
    "op11_periodic_runs": (periodic.op11_periodic_runs, periodic.ORACLE),
    "op12_prefix_trie": (trie.op12_prefix_trie, trie.ORACLE),
    "op13_nearest_neighbours": (ann.op13_nearest_neighbours, None),
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}
