"""Running totals over a whole table without sorting it in one task.

Rows are dealt by value ranges into the session's partitions and written with the
number of their range. Ranges are sorted separately, and the totals of the ranges
before are added: one row per range and group. No cut point reaches the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage


def _ordered(name: str, descending: bool) -> Column:
    return F.col(name).desc() if descending else F.col(name).asc()


def by_ranges(df: DataFrame, value: str, descending: bool = False) -> DataFrame:
    """The table, written, with ``__range``: the number of the value range a row is in, in the order of the values."""
    dealt = df.repartitionByRange(_ordered(value, descending))
    return stage(dealt.withColumn("__range", F.spark_partition_id()), "ranges")


def running_totals(
    df: DataFrame, value: str, sums: dict[str, str], groups: Sequence[str] = (), descending: bool = False
) -> DataFrame:
    """Adds inclusive running totals of ``sums`` (source column -> new column) along ``value``.

    ``df`` holds one row per value and group, so a range cannot grow by repeated values.
    """
    ranged = by_ranges(df, value, descending)
    inner = Window.partitionBy(*groups, "__range").orderBy(_ordered(value, descending)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    before = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(*groups, "__range").agg(*[F.sum(s).alias(f"__sum_{t}") for s, t in sums.items()])
    offsets = totals.select(
        *[F.col(g).alias(f"__of_{g}") for g in groups], F.col("__range").alias("__of"),
        *[F.coalesce(F.sum(f"__sum_{t}").over(before), F.lit(0)).alias(f"__off_{t}") for t in sums.values()],
    )
    inside = ranged.select("*", *[F.sum(s).over(inner).alias(f"__in_{t}") for s, t in sums.items()])
    same = F.col("__range") == F.col("__of")
    for g in groups:
        same &= F.col(g).eqNullSafe(F.col(f"__of_{g}"))
    return inside.join(offsets, same).select(
        *df.columns, *[(F.col(f"__in_{t}") + F.col(f"__off_{t}")).alias(t) for t in sums.values()]
    )


def positions(keys: DataFrame, column: str, name: str) -> DataFrame:
    """(column, name): place from 0 of each distinct value, text or number, in order."""
    counted = keys.select(column, F.lit(1).alias("__one"))
    return running_totals(counted, column, {"__one": name}).select(column, (F.col(name) - 1).alias(name))
