"""Corpus preparation: documents through five stages, each written and read again.

Stages: quality classifier (rejected documents go), exact dedup (one row of equal texts stays),
n-gram Jaccard join (one document of each group of near copies stays), mixing (rows repeat as
often as the mix takes them), SentencePiece encoding (ids, and what they decode to).
All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gistmill.llm import exact_dedup, jaccard_join, mixing, quality_classifier, sentencepiece_codec
from gistmill.llm.common import documents, release_memory, write_table

#: Near copies share 80 % of their 5-word shingles; op10 keeps its own 4 words and 85 %.
NEAR_SHINGLE, NEAR_PERCENT = 5, 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_classifier.classify_stage(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup_stage(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.near_dedup_stage(docs, shingle=NEAR_SHINGLE, percent=NEAR_PERCENT)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixing_stage(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(docs, sentencepiece_codec.default_model(), with_text=True)



def lean(stage: Stage) -> Stage:
    """``stage``, with what ended jobs hold in the driver and on disks given back before it and once its plan stands."""

    def run_lean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_memory(spark)
        out = stage(spark, docs, sf_dir)
        release_memory(spark)
        return out

    return run_lean


STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", lean(classify)),
    ("exact_dedup", lean(dedup)),
    ("jaccard_join", lean(near_dedup)),
    ("mixing", lean(mix)),
    ("sentencepiece", lean(encode)),
]

#: Training, random rounding and Viterbi have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = write_table(stage(spark, docs, sf_dir), name)
    return docs
