"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from haulscope.llm import (
    decontamination,
    line_dedup,
    merkle_manifest,
    mixing,
    pii_bootstrap,
    quality_rules,
    sharding,
    simhash_dedup,
    suffix_dedup,
    token_counts,
    tokenizer_alignment,
    toxicity,
    wrapper_induction,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_simhash_dedup": simhash_dedup.query,
        "op2_toxicity": toxicity.query,
        "op3_wrapper_induction": wrapper_induction.query,
        "op4_mixing": mixing.query,
        "op5_token_counts": token_counts.query,
        "op6_decontamination": decontamination.query,
        "op7_suffix_dedup": suffix_dedup.query,
        "op8_quality_rules": quality_rules.query,
        "op9_line_dedup": line_dedup.query,
        "op10_sharding": sharding.query,
        "op11_pii_bootstrap": pii_bootstrap.query,
        "op12_tokenizer_alignment": tokenizer_alignment.query,
        "op13_merkle_manifest": merkle_manifest.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op6_decontamination": decontamination.oracle(),
        "op8_quality_rules": quality_rules.oracle(),
        "op9_line_dedup": line_dedup.oracle(),
        "op10_sharding": sharding.oracle(),
        "op13_merkle_manifest": merkle_manifest.oracle(),
    }
