"""The registered queries of the corpus operators and of the pipeline, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from tramline.llm import (
    bpe,
    conversations,
    decontamination,
    fingerprints,
    infilling,
    lm_scoring,
    mixing,
    ngram_join,
    pii,
    quality_classifier,
    quality_rules,
    toxicity,
    url_filters,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_ngram_join": ngram_join.op1_ngram_join,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_quality_rules": quality_rules.op3_quality_rules,
        "op4_mixing": mixing.op4_mixing,
        "op5_lm_scoring": lm_scoring.op5_lm_scoring,
        "op6_quality_classifier": quality_classifier.op6_quality_classifier,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_url_filters": url_filters.op8_url_filters,
        "op9_bpe": bpe.op9_bpe,
        "op10_pii": pii.op10_pii,
        "op11_conversation_repair": conversations.op11_conversation_repair,
        "op12_infilling": infilling.op12_infilling,
        "op13_decontamination": decontamination.op13_decontamination,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    found = {
        "op3_quality_rules": quality_rules.ORACLE_SQL,
        "op8_url_filters": url_filters.ORACLE_SQL,
        "op11_conversation_repair": conversations.ORACLE_SQL,
        "op12_infilling": infilling.ORACLE_SQL,
        "op13_decontamination": decontamination.ORACLE_SQL,
        "pipeline": corpus_pipeline.ORACLE_SQL,
    }
    return {name: sql for name, sql in found.items() if sql}
