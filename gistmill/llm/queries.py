"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, jaccard_join, mixing, quality_classifier, quality_rules, sentencepiece_codec, suffix_dedup, token_files, url_filters, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_sentencepiece": sentencepiece_codec.op2_sentencepiece,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_warc": warc.op5_warc,
    "op6_quality_classifier": quality_classifier.op6_quality_classifier,
    "op7_url_filters": url_filters.op7_url_filters,
    "op8_token_files": token_files.op8_token_files,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}

ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": quality_rules.ORACLE_SQL,
    "op5_warc": warc.ORACLE_SQL,
    "op7_url_filters": url_filters.ORACLE_SQL,
    "op9_exact_dedup": exact_dedup.ORACLE_SQL,
}
