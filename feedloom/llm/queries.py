"""Registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from feedloom.llm import audit, decontaminate, language, mixing, neural, passages, quality, rules, sharding, simhash, topk, trie, warc
from feedloom.llm.ship import shipping

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_shard_documents": sharding.op1_shard_documents,
    "op10_shared_passages": passages.op10_shared_passages,
    "op11_filter_audit": audit.op11_filter_audit,
    "op12_top_products": topk.op12_top_products,
    "op13_prefix_trie": trie.op13_prefix_trie,
    "op2_mix_sources": mixing.op2_mix_sources,
    "op3_benchmark_templates": decontaminate.op3_benchmark_templates,
    "op4_language": language.op4_language,
    "op5_resolve_revisits": warc.op5_resolve_revisits,
    "op6_quality_grades": quality.op6_quality_grades,
    "op7_simhash_near_duplicates": simhash.op7_simhash_near_duplicates,
    "op8_neural_scores": neural.op8_neural_scores,
    "op9_outlier_rules": rules.op9_outlier_rules,
}
QUERIES = {name: shipping(fn) for name, fn in QUERIES.items()}

CHECKS: dict[str, str] = {
    "op1_shard_documents": sharding.OP1_SQL,
    "op11_filter_audit": audit.OP11_SQL,
    "op12_top_products": topk.OP12_SQL,
    "op13_prefix_trie": trie.OP13_SQL,
    "op2_mix_sources": mixing.OP2_SQL,
    "op5_resolve_revisits": warc.OP5_SQL,
}
