"""The registered queries of the operators and their DuckDB oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from auxograph.llm import chat, conversation_repair, decontamination, exact_dedup, mixing, near_dedup, quality, quality_rules, sharding, spelling, substring_dedup, token_store, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    """Each query by name; called with (spark, folder of the tables)."""
    return {
        "op1_exact_dedup": exact_dedup.query,
        "op2_mixing": mixing.query,
        "op3_sharding": sharding.query,
        "op4_quality": quality.query,
        "op5_toxicity": toxicity.query,
        "op6_chat": chat.query,
        "op7_near_dedup": near_dedup.query,
        "op8_substring_dedup": substring_dedup.query,
        "op9_decontamination": decontamination.query,
        "op10_token_store": token_store.query,
        "op11_conversation_repair": conversation_repair.query,
        "op12_quality_rules": quality_rules.query,
        "op13_spelling_variants": spelling.query,
    }


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL with the rows of the query of the same name, where SQL can express it."""
    return {
        "op1_exact_dedup": exact_dedup.SQL,
        "op2_mixing": mixing.SQL,
        "op3_sharding": sharding.SQL,
        "op6_chat": chat.SQL,
        "op7_near_dedup": near_dedup.SQL,
        "op8_substring_dedup": substring_dedup.SQL,
        "op9_decontamination": decontamination.SQL,
        "op11_conversation_repair": conversation_repair.SQL,
        "op12_quality_rules": quality_rules.SQL,
        "op13_spelling_variants": spelling.SQL,
    }
