"""Repeated rows, found by hash before whole rows are compared.

Rows are first counted by an eight-byte hash. A hash seen once belongs to a row
without a copy, which then is neither grouped nor compared; only rows whose hash
repeats are compared in full. Hash collisions cost time, not correctness. The
repeated hashes are a written table, so the engine knows their size when it
chooses how to join them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .columns import present


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[present(df, c) for c in df.columns])


def _with_repeats(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows with ``__hash``, and the hashes that more than one row has."""
    counts = df.select(row_hash(df).alias("__hash")).groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    return df.withColumn("__hash", row_hash(df)), stage(counts.where("__n > 1").select("__hash"), "repeated")


def distinct_rows(df: DataFrame) -> DataFrame:
    """One of each set of identical rows; missing equals missing."""
    rows = df.select(*[present(df, c).alias(c) for c in df.columns])
    hashed, repeated = _with_repeats(rows)
    single = hashed.join(repeated, "__hash", "left_anti").drop("__hash")
    return single.unionByName(hashed.join(repeated, "__hash", "left_semi").drop("__hash").dropDuplicates())


def surplus_rows(df: DataFrame) -> DataFrame:
    """One row, ``duplicate_rows``: rows beyond the first of each set of identical rows."""
    hashed, repeated = _with_repeats(df)
    keys = [present(df, c).alias(f"c{i}") for i, c in enumerate(df.columns)]
    groups = hashed.join(repeated, "__hash", "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))
