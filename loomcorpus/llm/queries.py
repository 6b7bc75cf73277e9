"""The queries of this subpackage, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomcorpus.llm import ann, exact_dedup, fim, hard_negatives, licenses, line_dedup, mixing, ngram_join, packing, quality_rules, substring_dedup, toxicity, warc
from loomcorpus.llm.common import table


def _over(name: str, op: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: op(table(spark, sf_dir, name))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_join": _over("documents", ngram_join.op1_ngram_join),
    "op2_substring_dedup": _over("documents", substring_dedup.op2_substring_dedup),
    "op3_packing": _over("documents", packing.op3_packing),
    "op4_collision_search": _over("embeddings", ann.op4_collision_search),
    "op5_quality_rules": _over("documents", quality_rules.op5_quality_rules),
    "op6_line_dedup": _over("documents", line_dedup.op6_line_dedup),
    "op7_warc_assembly": _over("pages", warc.op7_warc_assembly),
    "op8_license_scan": _over("documents", licenses.op8_license_scan),
    "op9_toxicity": lambda spark, sf_dir: toxicity.op9_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op10_mixing": lambda spark, sf_dir: mixing.op10_mixing(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_fill_in_middle": _over("documents", fim.op11_fill_in_middle),
    "op12_exact_dedup": _over("documents", exact_dedup.op12_exact_dedup),
    "op13_hard_negatives": _over("embeddings", hard_negatives.op13_hard_negatives),
}

ORACLE_SQL: dict[str, str] = {
    "op1_ngram_join": ngram_join.OP1_SQL,
    "op5_quality_rules": quality_rules.OP5_SQL,
    "op6_line_dedup": line_dedup.OP6_SQL,
    "op7_warc_assembly": warc.OP7_SQL,
    "op8_license_scan": licenses.OP8_SQL,
    "op11_fill_in_middle": fim.OP11_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
