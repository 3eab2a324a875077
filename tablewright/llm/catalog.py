"""The registered queries of this package, and the SQL checks of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import scratch_path, stage
from . import alignment, bpe, counts, decontaminate, language, licenses, minhash, orc_tokens, periodic, quality, rules, simhash, toxicity
from .texts import remainder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query
def op1_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.matches(documents(spark, folder).select("doc_id", "text"), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query
def op2_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    ranks = vocabulary("byte_bpe_50k.tiktoken")
    tokens = bpe.encode(documents(spark, folder).select("doc_id", "text"), ranks, public_tokenizers.PATTERN)
    return bpe.digests(tokens, ranks)


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    counted = stage(rules.measure(documents(spark, folder)).select("doc_id", "lang", "source", *rules.COUNTS), "rule-counts")
    judged = rules.judge(counted, rules.limits(counted))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("reasons", ",").alias("reasons")
    )


def labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def held_out(by: int, rest: int):
    return F.coalesce(remainder(F.col("doc_id"), by) == rest, F.lit(True)).alias("held_out")


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    judged = toxicity.judge(docs, toxicity.learn(docs, labels(spark, folder)))
    return judged.select("doc_id", held_out(*toxicity.HELD_OUT), "score", "predicted", "toxic_by_language")


@query
def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text")
    judged = quality.judge(docs, quality.learn(docs, labels(spark, folder)))
    return judged.select("doc_id", held_out(*quality.HELD_OUT), "score", "predicted")


@query
def op6_orc_tokens(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "orc-tokens")
    orc_tokens.write_tokens(documents(spark, folder), path, vocabulary("word_bpe_49k.json"))
    narrow = orc_tokens.with_starts(orc_tokens.checksums(orc_tokens.read_tokens(spark, path)))
    return narrow.select("doc_id", "start", "n_tokens", "ids_crc32")


@query
def op10_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return counts.measure(documents(spark, folder).select("doc_id", "text"), vocabulary("byte_bpe_50k.json")).drop("text")


@query
def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.summary(documents(spark, folder).select("doc_id", "text"))


@query
def op8_simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, folder))
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op9_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    told = language.predict(docs, language.learn(language.learning_rows(docs)))
    return told.select("doc_id", held_out(3, 1), "lang_pred", "score")


@query
def op11_minhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, folder))


@query
def op12_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    paths = vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model")
    aligned = alignment.align(documents(spark, folder).select("doc_id", "text"), *paths).drop("text")
    found = alignment.score(aligned, *paths)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    return periodic.summary(periodic.find(periodic.with_tails(documents(spark, folder).select("doc_id", "text"))))
