"""Documents through the training-data stages; every stage reads what the one before it wrote."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tablewright.llm import bpe, decontaminate, language, rules, simhash
from tablewright.session import stage

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: A text whose closest language is farther than this is of none.
LEAST_COSINE = 0.2


def quality_rules(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows that pass the fixed rules and the limits of their language and source."""
    return rules.keep(docs)


def language_id(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows whose text is close to a language; profiles are learned from the rows of this stage that have one."""
    found = language.compare(F.col("text"), language.learn(language.learning_rows(docs)))
    # One filter on one struct: the texts are compared once.
    return docs.withColumn("__found", found).where(
        (F.col("__found.lang_pred") != language.UNDETERMINED) & (F.col("__found.score") >= LEAST_COSINE)
    ).drop("__found")


def near_dedup(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """One row of each group of texts whose five-word shingles have a similarity of 0.8 or more."""
    return simhash.deduplicate(docs, words=5, least=(4, 5))


def decontamination(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Rows without a passage of the benchmark."""
    return decontaminate.clean(docs, spark.read.parquet(f"{folder}/benchmark.parquet"))


def byte_bpe(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Ids of the kept texts and the bytes they decode to, as digests: one row per document."""
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]

#: Hypervectors, trees and searches are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, apply in STAGES:
        docs = stage(apply(spark, docs, folder), f"pipeline-{name}")
    return docs
