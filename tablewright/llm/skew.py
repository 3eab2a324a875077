"""Joins that split the rows of a hot key."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCKS = 16  # parts that the rows of one key are split into


def beside(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """Join ``table``, which has one row for a ``key``, to ``rows``; the rows of a key are split in ``BLOCKS`` by the column ``by``.

    The table's row is sent once to every block in which its key stands.
    """
    split = rows.withColumn("__block", F.pmod(F.xxhash64(by), F.lit(BLOCKS)))
    wanted = split.select(key, "__block").distinct().join(table, key)
    return split.join(wanted, [key, "__block"], how).drop("__block")
