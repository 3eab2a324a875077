"""Small table builders: one-row results to long form, branch unions."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, functions as F

from .columns import quoted


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def one_row_to_long(row: DataFrame, entries: Sequence[dict[str, Column]]) -> DataFrame:
    """One output row per entry, each entry naming its fields, from a one-row frame."""
    structs = [F.struct(*[c.alias(k) for k, c in entry.items()]) for entry in entries]
    return row.select(F.inline(F.array(*structs)))


def wide_to_long(df: DataFrame, columns: dict[str, Column], name: str = "column", value: str = "value") -> DataFrame:
    """(name, value) rows for the non-null values of several columns of one type."""
    wide = df.select(*[c.alias(n) for n, c in columns.items()])
    return wide.unpivot([], [quoted(n) for n in columns], name, value).where(F.col(value).isNotNull())


def batches(items: Sequence, size: int) -> list[list]:
    return [list(items[i : i + size]) for i in range(0, len(items), size)]


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys``; without keys ``right`` is one row that applies to every row of ``left``."""
    if keys:
        return left.join(right, list(keys), how)
    return left.withColumn("__one", F.lit(1)).join(right.withColumn("__one", F.lit(1)), "__one", how).drop("__one")


def spread_by(df: DataFrame, keys: Sequence[str], whole_groups: bool = False) -> DataFrame:
    """Partition by ``keys`` into the session's full number of shuffle partitions.

    For work that is heavy per group on few bytes: adaptive execution sizes
    partitions by bytes and would put all groups into one task. ``whole_groups``
    is for one row per key, which may already be partitioned by ``keys`` after
    such a merge; a hash of the keys forces a new exchange.
    """
    if not keys:
        return df
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(count, *([F.xxhash64(*keys)] if whole_groups else [F.col(k) for k in keys]))


BRANCHES = 24


def in_batches(df: DataFrame, columns: Sequence[str], build: Callable[[list[str]], DataFrame]) -> DataFrame:
    """``build`` over the columns, for results of one row per column.

    A wide table runs as several queries, so that no plan has a branch for each
    of its columns; their rows, one per column, are put together on the driver.
    """
    parts = [build(names) for names in batches(list(columns), BRANCHES)]
    if len(parts) == 1:
        return parts[0]
    rows = [row for part in parts for row in part.collect()]
    return df.sparkSession.createDataFrame(rows, parts[0].schema)


def map_in_threads(df: DataFrame, work: Callable, items: Sequence, threads: int = 4) -> list:
    """Independent small-result queries side by side, each with a plan of its own."""
    pool = ThreadPool(max(1, min(threads, len(items))))
    try:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items)
    finally:
        pool.close()


def union_or_gather(df: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """Union of frames whose rows the schema bounds; beyond a few, each runs as its own query."""
    if len(parts) <= BRANCHES:
        return union_all(parts)
    rows = [row for found in map_in_threads(df, lambda part: part.collect(), parts) for row in found]
    return df.sparkSession.createDataFrame(rows, parts[0].schema)
