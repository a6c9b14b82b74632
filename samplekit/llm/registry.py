"""The queries of the corpus operators and the SQL that some of them can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from samplekit.llm import conversation_repair, decontamination, license_scan, line_dedup, lm_scoring, packing, pii, quality_classifier, quality_rules, secret_scan, simhash, spelling, suffix_dedup
from samplekit.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def queries() -> dict[str, Query]:
    return {
        "op1_suffix_dedup": lambda spark, d: suffix_dedup.op1_suffix_dedup(table(spark, d, "documents")),
        "op2_best_fit_packing": lambda spark, d: packing.op2_best_fit_packing(table(spark, d, "documents"), tokenizer_path()),
        "op3_line_dedup": lambda spark, d: line_dedup.op3_line_dedup(table(spark, d, "documents")),
        "op4_license_scan": lambda spark, d: license_scan.op4_license_scan(table(spark, d, "documents")),
        "op5_simhash": lambda spark, d: simhash.op5_simhash(table(spark, d, "documents")),
        "op6_pii": lambda spark, d: pii.op6_pii(table(spark, d, "documents")),
        "op7_lm_scoring": lambda spark, d: lm_scoring.op7_lm_scoring(table(spark, d, "documents"), tokenizer_path("piece_bpe_32k.model")),
        "op8_decontamination": lambda spark, d: decontamination.op8_decontamination(table(spark, d, "documents"), table(spark, d, "benchmark")),
        "op9_quality_classifier": lambda spark, d: quality_classifier.op9_quality_classifier(table(spark, d, "documents"), table(spark, d, "labels")),
        "op10_quality_rules": lambda spark, d: quality_rules.op10_quality_rules(table(spark, d, "documents")),
        "op11_spelling_variants": lambda spark, d: spelling.op11_spelling_variants(table(spark, d, "documents")),
        "op12_secret_scan": lambda spark, d: secret_scan.op12_secret_scan(table(spark, d, "documents")),
        "op13_conversation_repair": lambda spark, d: conversation_repair.op13_conversation_repair(table(spark, d, "conversations")),
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_dedup": line_dedup.OP3_SQL, "op8_decontamination": decontamination.OP8_SQL}
