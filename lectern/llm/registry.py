"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.llm import bpe, conversation_repair, jaccard_join, lexical_search, license_scan, line_dedup, packing, quality, quality_classifier, substring_dedup, topk_search, toxicity, warc
from lectern.session import load


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(load(spark, sf_dir, table))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": _over("documents", bpe.op1_bpe),
    "op2_line_dedup": _over("documents", line_dedup.op2_line_dedup),
    "op3_packing": _over("documents", packing.op3_packing),
    "op4_toxicity": lambda spark, sf_dir: toxicity.op4_toxicity(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
    "op5_license_scan": _over("documents", license_scan.op5_license_scan),
    "op6_quality_rules": _over("documents", quality.op6_quality_rules),
    "op7_substring_dedup": _over("documents", substring_dedup.op7_substring_dedup),
    "op8_topk_search": _over("embeddings", topk_search.op8_topk_search),
    "op9_jaccard_join": _over("documents", jaccard_join.op9_jaccard_join),
    "op10_warc": _over("pages", warc.op10_warc),
    "op11_lexical_search": lambda spark, sf_dir: lexical_search.op11_lexical_search(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark")),
    "op12_conversation_repair": _over("conversations", conversation_repair.op12_conversation_repair),
    "op13_quality_classifier": lambda spark, sf_dir: quality_classifier.op13_quality_classifier(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")),
}

ORACLES: dict[str, str] = {
    "op2_line_dedup": line_dedup.ORACLE_SQL,
    "op6_quality_rules": quality.ORACLE_SQL,
    "op7_substring_dedup": substring_dedup.ORACLE_SQL,
    "op8_topk_search": topk_search.ORACLE_SQL,
    "op9_jaccard_join": jaccard_join.ORACLE_SQL,
    "op10_warc": warc.ORACLE_SQL,
    "op11_lexical_search": lexical_search.ORACLE_SQL,
    "op12_conversation_repair": conversation_repair.ORACLE_SQL,
}
