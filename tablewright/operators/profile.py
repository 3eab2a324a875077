"""Profiling: counts, distinct values, kinds and flags per column.

One aggregate pass counts missing values of all columns. Distinct values need
one shuffle per column; each branch reads its own column only and combines
equal values before the shuffle, so a value held by most rows costs one row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import (
    CATEGORICAL, DATE_FORMATS, DATETIME, NUMERICAL, columns_of_kind, display_text, is_missing, kind_of, parse_number,
    present, quoted,
)
from ..functions.copies import surplus_rows
from ..functions.tables import in_batches, join_by, one_row_to_long, union_all

LOW_CARDINALITY = 10
HIGH_CARDINALITY_RATIO = 0.5
SAMPLE_SIZE = 50
SAMPLE_ROWS = 4 * SAMPLE_SIZE
DATE_SHARE = 0.8
NUMBER_SHARE = 0.9


def missing_counts(df: DataFrame) -> DataFrame:
    """One row: ``rows`` and one missing count per column position (``m0``, ``m1``, ...)."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count_if(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(df.columns)],
    )


def missing_by_column(df: DataFrame) -> DataFrame:
    entries = [{"column": F.lit(c), "missing": F.col(f"m{i}")} for i, c in enumerate(df.columns)]
    return one_row_to_long(missing_counts(df), entries).orderBy(F.desc("missing"), "column")


def missing_summary(df: DataFrame) -> DataFrame:
    return missing_by_column(df).filter("missing > 0")


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows; missing equals missing."""
    return surplus_rows(df)


def profile_summary(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows and missing values of the table."""
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    counts = missing_counts(df).select("rows", F.lit(len(df.columns)).alias("columns"), total.cast("long").alias("total_missing"))
    return join_by(counts, surplus_rows(df), []).select("rows", "columns", "duplicate_rows", "total_missing")


LONG_TEXT = 64


def distinct_key(df: DataFrame, column: str) -> Column:
    """The value, or the digest of a long text: equal for equal values, and short to shuffle."""
    c = present(df, column)
    if kind_of(df.schema[column].dataType) != CATEGORICAL:
        return c
    return F.when(F.length(c) > LONG_TEXT, F.concat(F.lit("sha256:"), F.sha2(c, 256))).otherwise(c)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) for the non-missing values of one column."""
    return df.select(present(df, column).alias("value")).where(F.col("value").isNotNull()).groupBy("value").agg(
        F.count(F.lit(1)).alias("n")
    )


def unique_values(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Distinct non-missing values per column; ``exact=False`` estimates all of them in one pass."""
    names = list(columns if columns is not None else df.columns)
    if not exact:
        row = df.agg(*[F.approx_count_distinct(present(df, c)).alias(f"u{i}") for i, c in enumerate(names)])
        return one_row_to_long(row, [{"column": F.lit(c), "unique": F.col(f"u{i}")} for i, c in enumerate(names)])
    return in_batches(df, names, lambda batch: _distinct_counts(df, batch))


def _distinct_counts(df: DataFrame, names: list[str]) -> DataFrame:
    found = [
        df.select(distinct_key(df, c).alias("value")).where("value is not null").distinct()
        .select(F.lit(c).alias("column"), F.lit(1).alias("n"))
        for c in names
    ]
    # A column without values has no distinct rows, so every column starts from zero.
    zero = df.sparkSession.createDataFrame([(c, 0) for c in names], "column string, n int")
    return union_all([zero, *found]).groupBy("column").agg(F.sum("n").alias("unique"))


def most_frequent(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column as text, with its count; ties go to the smallest value."""
    return in_batches(df, columns, lambda batch: _modes(df, batch))


def _modes(df: DataFrame, columns: list[str]) -> DataFrame:
    branches = []
    for c in columns:
        values = df.select(F.when(~is_missing(df, c), display_text(df, c)).alias("value")).where(F.col("value").isNotNull())
        counts = values.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
        best = counts.agg(F.min(F.struct((-F.col("n")).alias("negative"), "value")).alias("best"), F.count(F.lit(1)).alias("unique"))
        branches.append(
            best.select(F.lit(c).alias("column"), F.col("best.value").alias("top"), (-F.col("best.negative")).alias("freq"), "unique")
        )
    return union_all(branches)


def column_kinds(df: DataFrame) -> DataFrame:
    """Type, kind and non-missing count per column."""
    entries = [
        {
            "column": F.lit(f.name),
            "ordinal": F.lit(i),
            "type": F.lit(f.dataType.simpleString()),
            "kind": F.lit(kind_of(f.dataType)),
            "non_missing": F.col("rows") - F.col(f"m{i}"),
        }
        for i, f in enumerate(df.schema.fields)
    ]
    return one_row_to_long(missing_counts(df), entries)


def dtype_summary(df: DataFrame) -> DataFrame:
    """Number of numerical, categorical and datetime columns, zero included."""
    kinds = column_kinds(df)
    counted = kinds.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in (NUMERICAL, CATEGORICAL, DATETIME)])
    return one_row_to_long(
        counted, [{"kind": F.lit(k), "columns": F.col(k)} for k in (NUMERICAL, CATEGORICAL, DATETIME)]
    )


def binary_columns(df: DataFrame) -> DataFrame:
    return unique_values(df).filter(F.col("unique") == 2).select("column")


def low_cardinality(df: DataFrame) -> DataFrame:
    return unique_values(df).filter(F.col("unique") <= LOW_CARDINALITY)


def high_cardinality(df: DataFrame) -> DataFrame:
    """Columns whose distinct values exceed half the rows; none for an empty table."""
    def build(names: list[str]) -> DataFrame:
        return union_all(
            [
                df.select(distinct_key(df, c).alias("value")).groupBy("value").agg(F.count(F.lit(1)).alias("n"))
                .agg(F.count("value").alias("unique"), F.sum("n").alias("rows"))
                .select(F.lit(c).alias("column"), "unique", "rows")
                for c in names
            ]
        )

    counts = in_batches(df, df.columns, build)
    return counts.filter(F.try_divide("unique", "rows") > HIGH_CARDINALITY_RATIO).select("column", "unique")


def text_samples(df: DataFrame, order_by: Sequence[str] | None = None, size: int = SAMPLE_SIZE) -> DataFrame:
    """The first non-missing values of every text column as (column, value).

    In table order by default, which reads only as many rows as needed; with
    ``order_by`` in the order of those keys. A few times ``size`` first rows
    serve all columns at once; a column with too many missing values among
    them gets a top-k of its own.
    """
    names = [c for c in columns_of_kind(df, CATEGORICAL) if c not in (order_by or [])]
    schema = "column string, value string"
    if not names:
        return df.sparkSession.createDataFrame([], schema)
    ordered = df.orderBy(*order_by) if order_by else df
    first = ordered.limit(SAMPLE_ROWS).select(*[quoted(c) for c in names]).collect()
    found = {c: [r[i] for r in first if r[i] is not None][:size] for i, c in enumerate(names)}
    settled = len(first) < SAMPLE_ROWS
    pairs = [(c, v) for c, values in found.items() if settled or len(values) == size for v in values]
    parts = [df.sparkSession.createDataFrame(pairs, schema)]
    for c, values in found.items():
        if not settled and len(values) < size:
            rows = df.where(quoted(c).isNotNull())
            rows = (rows.orderBy(*order_by) if order_by else rows).limit(size)
            parts.append(rows.select(F.lit(c).alias("column"), quoted(c).cast("string").alias("value")))
    return union_all(parts)


def text_facts(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Per text column: the layout that parses most of the sample (first on ties), its share, and the share of numbers."""
    rates = text_samples(df, order_by).groupBy("column").agg(
        *[
            F.avg(F.try_to_timestamp("value", F.lit(f)).isNotNull().cast("double")).alias(f"f{i}")
            for i, f in enumerate(DATE_FORMATS)
        ],
        F.avg(parse_number(F.col("value")).isNotNull().cast("double")).alias("number_share"),
    )
    best = F.greatest(*[F.col(f"f{i}") for i in range(len(DATE_FORMATS))])
    winner = F.coalesce(*[F.when(F.col(f"f{i}") == best, F.lit(f)) for i, f in enumerate(DATE_FORMATS)])
    return rates.select("column", winner.alias("format"), best.alias("date_share"), "number_share")


def date_candidates(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Text columns of which at least 80 % of the sample parses in one layout."""
    return text_facts(df, order_by).where(F.col("date_share") >= DATE_SHARE).select(
        "column", "format", F.col("date_share").alias("success_rate")
    )


def numeric_like_text(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """Text columns whose sample is more than 90 % numbers once separators and signs are removed."""
    return text_facts(df, order_by).where(F.col("number_share") > NUMBER_SHARE).select(
        "column", F.col("number_share").alias("success_rate")
    )


def inspect_dataset(df: DataFrame) -> DataFrame:
    """Rows, columns, names, types and missing values in one record."""
    total = sum((F.col(f"m{i}") for i in range(len(df.columns))), F.lit(0))
    types = F.create_map(*[F.lit(x) for f in df.schema.fields for x in (f.name, f.dataType.simpleString())])
    return missing_counts(df).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        F.array(*[F.lit(c) for c in df.columns]).alias("columns_list"),
        types.alias("dtypes"),
        total.alias("missing_values"),
    )


def column_profile(df: DataFrame, order_by: Sequence[str] | None = None) -> DataFrame:
    """All facts and flags, one row per column."""
    facts = one_row_to_long(
        missing_counts(df),
        [
            {
                "column": F.lit(f.name),
                "ordinal": F.lit(i),
                "type": F.lit(f.dataType.simpleString()),
                "kind": F.lit(kind_of(f.dataType)),
                "rows": F.col("rows"),
                "missing": F.col(f"m{i}"),
            }
            for i, f in enumerate(df.schema.fields)
        ],
    )
    texts = text_facts(df, order_by).select(
        "column", F.when(F.col("date_share") >= DATE_SHARE, F.col("format")).alias("date_format"),
        (F.col("number_share") > NUMBER_SHARE).alias("is_numeric_like"),
    )
    return (
        facts.join(unique_values(df), "column")
        .join(texts, "column", "left")
        .select(
            "column", "ordinal", "type", "kind", "rows", "missing", "unique",
            (F.col("unique") == 2).alias("is_binary"),
            F.col("date_format").isNotNull().alias("is_date_candidate"),
            "date_format",
            F.coalesce("is_numeric_like", F.lit(False)).alias("is_numeric_like"),
            (F.col("unique") <= LOW_CARDINALITY).alias("is_low_cardinality"),
            F.coalesce(F.try_divide("unique", "rows") > HIGH_CARDINALITY_RATIO, F.lit(False)).alias("is_high_cardinality"),
        )
    )
