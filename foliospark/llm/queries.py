"""Queries of the training-data operators, by name, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import bpe, imatch, langid, lbl, line_dedup, minhash, packing, quality, rules, toxicity
from foliospark.llm.common import documents, labels, small_batches


def _on_documents(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(documents(spark, sf_dir))

    return run


def _on_labelled(query):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return query(documents(spark, sf_dir), labels(spark, sf_dir))

    return run


QUERIES = {
    "op1_line_dedup": _on_documents(line_dedup.query),
    "op2_minhash_near_dedup": _on_documents(minhash.query),
    "op3_quality_rules": _on_documents(rules.query),
    "op4_lm_scoring": _on_documents(lbl.query),
    "op5_quality_classifier": _on_labelled(quality.query),
    "op6_language_id": _on_documents(langid.query),
    "op7_imatch_fingerprints": _on_documents(imatch.query),
    "op8_toxicity": _on_labelled(toxicity.query),
    "op9_best_fit_packing": _on_documents(packing.query),
    "op10_byte_bpe": _on_documents(bpe.query),
    "rule_ablations": _on_documents(rules.ablation_query),
}

ORACLE = {
    "op1_line_dedup": line_dedup.ORACLE,
    "op2_minhash_near_dedup": minhash.ORACLE,
    "op3_quality_rules": rules.ORACLE,
    "rule_ablations": rules.ABLATION_ORACLE,
}
