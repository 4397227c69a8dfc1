"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (byte_bpe, exact_dedup, fingerprints, hard_negatives, lexical_search, near_dedup, ngram_join, packing, secret_scans,
               sharding, substring_dedup, token_counts, toxicity)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": packing.op1_best_fit_packing,
        "op2_exact_dedup": exact_dedup.op2_exact_dedup,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_substring_dedup": substring_dedup.op4_substring_dedup,
        "op4_passage_dedup": substring_dedup.op4_passage_dedup,
        "op5_fingerprints": fingerprints.op5_fingerprints,
        "op6_token_counts": token_counts.op6_token_counts,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_sharding": sharding.op8_sharding,
        "op9_near_dedup": near_dedup.op9_near_dedup,
        "op10_secret_scans": secret_scans.op10_secret_scans,
        "op11_lexical_search": lexical_search.op11_lexical_search,
        "op12_ngram_join": ngram_join.op12_ngram_join,
        "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": exact_dedup.ORACLE_SQL, "op4_substring_dedup": substring_dedup.ORACLE_SQL,
            "op6_token_counts": token_counts.ORACLE_SQL, "op9_near_dedup": near_dedup.ORACLE_SQL,
            "op10_secret_scans": secret_scans.oracle_sql(), "op11_lexical_search": lexical_search.ORACLE_SQL,
            "op12_ngram_join": ngram_join.ORACLE_SQL, "op13_hard_negatives": hard_negatives.ORACLE_SQL}
