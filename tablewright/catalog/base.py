"""Registry of runnable queries, each with its SQL check where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """Parquet tables of one data folder, read on use."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``name``."""

    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = sql
        return fn

    return add


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, negative zero made zero.

    A thousandth of the last digit is added first: sums taken in another order
    then still round a half the same way.
    """
    return df.select(
        *[
            (F.round(F.col(f"`{f.name}`") + F.lit(10.0 ** -(digits + 3)), digits) + F.lit(0.0)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def r(expr: str, digits: int = 6) -> str:
    """SQL text of the same rounding."""
    return f"(round(cast({expr} as double) + 1e-{digits + 3}, {digits}) + 0.0)"


# Columns with missing values, currency text and text dates, in SQL both engines run.
MESSY_COLUMNS = [
    "l_returnflag",
    "l_linestatus",
    "l_linenumber",
    "case when l_partkey % 7 = 0 then null else l_quantity end as qty",
    "case when l_partkey % 11 = 0 then null else concat('$', cast(cast(floor(l_extendedprice) as bigint) as string)) end as price_txt",
    "case when l_partkey % 13 = 0 then null else cast(cast(l_shipdate as date) as string) end as ship_txt",
    "case when l_partkey % 5 = 0 then null else l_returnflag end as flag",
]
KEY_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey"]
ROW_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def messy(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*MESSY_COLUMNS)


def messy_keyed(t: Tables) -> DataFrame:
    """The same with key columns, for operators that need a row order."""
    return t.lineitem.selectExpr(*KEY_COLUMNS, *MESSY_COLUMNS)


MESSY = f"messy as (select {', '.join(MESSY_COLUMNS)} from lineitem)"
MESSY_KEYED = f"messy_keyed as (select {', '.join(KEY_COLUMNS + MESSY_COLUMNS)} from lineitem)"

DUP_COLUMNS = ["l_returnflag", "l_linestatus", "l_linenumber", "case when l_partkey % 7 = 0 then null else l_quantity end as qty"]


def dup(t: Tables) -> DataFrame:
    return t.lineitem.selectExpr(*DUP_COLUMNS)


DUP = f"dup as (select {', '.join(DUP_COLUMNS)} from lineitem)"


def per_column(template: str, columns: list[str]) -> str:
    """UNION ALL of one SELECT per column; ``{c}`` is the column, ``{i}`` its position."""
    return " union all ".join(template.format(c=c, i=i) for i, c in enumerate(columns))
