"""The queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tilepyramid.llm import (
    conversations,
    cotraining,
    decontamination,
    embedding_dedup,
    html_extraction,
    language_id,
    licenses,
    mixing,
    ngram_join,
    resampling,
    secret_scan,
    sharding,
    warc,
)

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_mixing": mixing.op1_mixing,
        "op2_ngram_join": ngram_join.op2_ngram_join,
        "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
        "op4_decontamination": decontamination.op4_decontamination,
        "op5_quality": cotraining.op5_quality,
        "op6_secrets": secret_scan.op6_secrets,
        "op7_language_id": language_id.op7_language_id,
        "op8_sharding": sharding.op8_sharding,
        "op9_warc": warc.op9_warc,
        "op10_licenses": licenses.op10_licenses,
        "op11_resampling": resampling.op11_resampling,
        "op12_html": html_extraction.op12_html,
        "op13_conversations": conversations.op13_conversations,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_mixing": mixing.OP1_SQL,
        "op2_ngram_join": ngram_join.OP2_SQL,
        "op3_embedding_dedup": embedding_dedup.OP3_SQL,
        "op4_decontamination": decontamination.OP4_SQL,
        "op9_warc": warc.OP9_SQL,
        "op10_licenses": licenses.OP10_SQL,
        "op11_resampling": resampling.OP11_SQL,
        "op13_conversations": conversations.OP13_SQL,
    }
