"""Registered queries of the corpus operators and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, chat, decontaminate, divergence, mixing, near_dedup, packing, pii, quality_model, quality_rules, sharding, token_files, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": quality_model.op1_quality,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontaminate": decontaminate.op3_decontaminate,
        "op4_near_dedup": near_dedup.op4_near_dedup,
        "op5_sharding": sharding.op5_sharding,
        "op6_quality_rules": quality_rules.op6_quality_rules,
        "op7_pii": pii.op7_pii,
        "op8_chat": chat.op8_chat,
        "op9_mixing": mixing.op9_mixing,
        "op10_token_ids": token_files.op10_token_ids,
        "op11_divergence": divergence.op11_divergence,
        "op12_packing": packing.op12_packing,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_decontaminate": decontaminate.OP3_SQL,
        "op4_near_dedup": near_dedup.OP4_SQL,
        "op5_sharding": sharding.OP5_SQL,
        "op6_quality_rules": quality_rules.OP6_SQL,
        "op8_chat": chat.OP8_SQL,
        "op11_divergence": divergence.OP11_SQL,
    }
