"""Registers one query for each corpus operator, over its whole table."""

from __future__ import annotations

from tallyspark.llm import byte_bpe, divergence, embedding_dedup, exact_dedup, fill_middle, license_scan, line_dedup, lm_score, mixing, near_dedup, private_data, quality, sharding
from tallyspark.llm.common import table


def queries() -> dict:
    return {
        "op1_license_scan": lambda spark, d: license_scan.query(table(spark, d, "documents")),
        "op2_minimax_shards": lambda spark, d: sharding.query(table(spark, d, "documents")),
        "op3_exact_dedup": exact_dedup.query,
        "op4_near_dedup": lambda spark, d: near_dedup.query(table(spark, d, "documents")),
        "op5_lm_score": lambda spark, d: lm_score.query(table(spark, d, "documents")),
        "op6_line_dedup": lambda spark, d: line_dedup.query(table(spark, d, "documents")),
        "op7_mix_sources": lambda spark, d: mixing.query(table(spark, d, "documents")),
        "op8_quality": lambda spark, d: quality.query(table(spark, d, "documents"), table(spark, d, "labels")),
        "op9_embedding_dedup": lambda spark, d: embedding_dedup.query(table(spark, d, "embeddings")),
        "op10_byte_bpe": lambda spark, d: byte_bpe.query(table(spark, d, "documents")),
        "op11_source_divergence": divergence.query,
        "op12_private_data": lambda spark, d: private_data.query(table(spark, d, "documents")),
        "op13_fill_middle": lambda spark, d: fill_middle.query(table(spark, d, "documents")),
    }


def oracle_sql() -> dict:
    return {"op3_exact_dedup": exact_dedup.SQL, "op6_line_dedup": line_dedup.SQL, "op11_source_divergence": divergence.SQL, "op13_fill_middle": fill_middle.SQL}
