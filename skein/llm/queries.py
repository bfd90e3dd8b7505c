"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from . import chat_format, decontaminate, hard_negatives, jaccard_join, language_id, license_scan, line_dedup, media, merkle_manifest, secret_scan, sentencepiece_codec, substring_dedup, token_counts


Query = Callable[[SparkSession, str], DataFrame]


def _shipped(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    plain = {
        "op1_license_scan": license_scan.query,
        "op2_jaccard_join": jaccard_join.query,
        "op3_media_columns": media.query,
        "op4_line_dedup": line_dedup.query,
        "op5_decontaminate": decontaminate.query,
        "op6_token_counts": token_counts.query,
        "op7_language_id": language_id.query,
        "op8_chat_format": chat_format.query,
        "op9_sentencepiece": sentencepiece_codec.query,
        "op10_substring_dedup": substring_dedup.query,
        "op11_merkle_manifest": merkle_manifest.query,
        "op12_secret_scan": secret_scan.query,
        "op13_hard_negatives": hard_negatives.query,
    }
    return {name: _shipped(query) for name, query in plain.items()}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_license_scan": license_scan.SQL,
        "op2_jaccard_join": jaccard_join.SQL,
        "op4_line_dedup": line_dedup.SQL,
        "op5_decontaminate": decontaminate.SQL,
        "op8_chat_format": chat_format.SQL,
        "op10_substring_dedup": substring_dedup.SQL,
        "op11_merkle_manifest": merkle_manifest.SQL,
        "op12_secret_scan": secret_scan.SQL,
        "op13_hard_negatives": hard_negatives.SQL,
    }
