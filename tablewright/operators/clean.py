"""Cleaning: duplicates, text to numbers and dates, imputation.

Fill values are fitted first, a handful of numbers per column, and the cleaned
table is then one lazy projection over the input.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import (
    BOOLEAN, CATEGORICAL, DATETIME, NUMERICAL, as_double, columns_of_kind, is_missing, parse_date, parse_number,
    present, quoted,
)
from ..functions.copies import distinct_rows, surplus_rows
from ..functions.quantiles import exact_quantiles
from ..functions.tables import join_by
from ..session import stage
from . import profile


def drop_duplicates(df: DataFrame) -> DataFrame:
    """One of each set of identical rows."""
    return distinct_rows(df)


def numeric_coerce(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: parse_number(quoted(c).cast("string")) for c in columns})


def date_coerce(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Text to timestamps with the layout found for each column; unparsable becomes missing."""
    return df.withColumns({c: parse_date(quoted(c).cast("string"), [f]) for c, f in formats.items()})


def _fill(df: DataFrame, values: dict[str, object]) -> DataFrame:
    """Null to the fitted value. An integer column widens only for a fractional fill."""
    out = []
    for f in df.schema.fields:
        c = present(df, f.name)
        value = values.get(f.name)
        if value is not None:
            fractional = isinstance(f.dataType, T.IntegralType) and float(value) != int(value)
            c = F.coalesce(c, F.lit(value) if fractional else F.lit(value).cast(f.dataType))
        out.append(c.alias(f.name))
    return df.select(*out)


def incomplete_columns(df: DataFrame, names: Sequence[str]) -> list[str]:
    """Columns that hold a missing value; the others need no fitting."""
    if not names:
        return []
    row = df.agg(*[F.max(is_missing(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return [c for i, c in enumerate(names) if row[f"m{i}"]]


def fit_medians(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> dict[str, float | None]:
    names = list(columns if columns is not None else columns_of_kind(df, NUMERICAL))
    if not names:
        return {}
    if not exact:
        row = df.agg(*[F.percentile_approx(as_double(df, c), 0.5, 10000).alias(f"m{i}") for i, c in enumerate(names)]).first()
        return {c: row[f"m{i}"] for i, c in enumerate(names)}
    found = exact_quantiles(df, {c: as_double(df, c) for c in names}, [0.5])
    return {c: v[0] for c, v in found.items()}


def fit_means(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, float | None]:
    names = list(columns if columns is not None else columns_of_kind(df, NUMERICAL))
    if not names:
        return {}
    row = df.agg(*[F.avg(as_double(df, c)).alias(f"m{i}") for i, c in enumerate(names)]).first()
    return {c: row[f"m{i}"] for i, c in enumerate(names)}


def fit_modes(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str | None]:
    names = list(columns if columns is not None else columns_of_kind(df, CATEGORICAL, DATETIME, BOOLEAN))
    if not names:
        return {}
    return {r["column"]: r["top"] for r in profile.most_frequent(df, names).collect()}


def median_impute(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Numeric missing to the column median; a column without values stays missing."""
    names = columns if columns is not None else columns_of_kind(df, NUMERICAL)
    return _fill(df, fit_medians(df, incomplete_columns(df, names), exact))


def mode_impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Non-numeric missing to the most frequent value, the smallest on ties."""
    names = columns if columns is not None else columns_of_kind(df, CATEGORICAL, DATETIME, BOOLEAN)
    return _fill(df, fit_modes(df, incomplete_columns(df, names)))


def mean_impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns if columns is not None else columns_of_kind(df, NUMERICAL)
    return _fill(df, fit_means(df, incomplete_columns(df, names)))


def mode_or_unknown_impute(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Mode for text; ``Unknown`` for a text column without any value."""
    names = incomplete_columns(df, columns if columns is not None else columns_of_kind(df, CATEGORICAL))
    modes = fit_modes(df, names)
    return _fill(df, {c: modes[c] if modes[c] is not None else "Unknown" for c in names})


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    return df.where(~is_missing(df, target))


@dataclass
class CleaningPlan:
    """What the profile asked for; fill values come from the deduplicated, coerced rows."""

    numeric: list[str] = field(default_factory=list)
    dates: dict[str, str] = field(default_factory=dict)


def plan_cleaning(df: DataFrame, order_by: Sequence[str] | None = None) -> CleaningPlan:
    """A column that reads both as a number and as a date becomes a number."""
    facts = profile.text_facts(df, order_by).collect()
    numeric = [r["column"] for r in facts if r["number_share"] > profile.NUMBER_SHARE]
    dates = {r["column"]: r["format"] for r in facts if r["date_share"] >= profile.DATE_SHARE}
    return CleaningPlan(
        [c for c in df.columns if c in numeric], {c: dates[c] for c in df.columns if c in dates and c not in numeric}
    )


def coerce(df: DataFrame, plan: CleaningPlan) -> DataFrame:
    return date_coerce(numeric_coerce(df, plan.numeric), plan.dates)


def clean_dataset(df: DataFrame, plan: CleaningPlan | None = None, order_by: Sequence[str] | None = None) -> DataFrame:
    """Deduplicate, coerce, then fill medians and modes.

    The deduplicated rows are written once, as columns: each fitting pass then
    reads the columns it needs instead of shuffling whole rows again.
    """
    plan = plan or plan_cleaning(df, order_by)
    coerced = stage(coerce(drop_duplicates(df), plan), "coerced")
    names = incomplete_columns(coerced, coerced.columns)
    numbers = [c for c in names if c in columns_of_kind(coerced, NUMERICAL)]
    others = [c for c in names if c in columns_of_kind(coerced, CATEGORICAL, DATETIME, BOOLEAN)]
    return _fill(coerced, {**fit_medians(coerced, numbers), **fit_modes(coerced, others)})


def cleaning_report(
    df: DataFrame, plan: CleaningPlan | None = None, order_by: Sequence[str] | None = None, cleaned: DataFrame | None = None
) -> DataFrame:
    """One record: duplicates removed, converted columns, remaining missing values, rows kept.

    After filling, a column is missing in every row or in none, so what remains
    are the columns without any value after coercion, once per row kept. With the
    ``cleaned`` table at hand everything is counted there, and no duplicate is
    looked for again.
    """
    plan = plan or plan_cleaning(df, order_by)
    if cleaned is not None:
        missing = sum((F.count_if(is_missing(cleaned, c)) for c in cleaned.columns), F.lit(0))
        counted = cleaned.agg(F.count(F.lit(1)).alias("kept"), missing.alias("missing"))
        return join_by(counted, df.agg(F.count(F.lit(1)).alias("rows")), []).select(
            (F.col("rows") - F.col("kept")).alias("duplicates_removed"),
            F.array(*[F.lit(c) for c in plan.numeric]).cast("array<string>").alias("numeric_converted"),
            F.array(*[F.lit(c) for c in plan.dates]).cast("array<string>").alias("date_converted"),
            F.col("missing").cast("long").alias("remaining_missing"),
            F.col("kept").alias("rows_after_cleaning"),
        )
    coerced = coerce(df, plan)
    values = coerced.agg(
        F.count(F.lit(1)).alias("rows"), *[F.count(present(coerced, c)).alias(f"n{i}") for i, c in enumerate(df.columns)]
    )
    empty = sum(((F.col(f"n{i}") == 0).cast("long") for i in range(len(df.columns))), F.lit(0))
    kept = F.col("rows") - F.col("duplicate_rows")
    return join_by(values, surplus_rows(df), []).select(
        F.col("duplicate_rows").alias("duplicates_removed"),
        F.array(*[F.lit(c) for c in plan.numeric]).cast("array<string>").alias("numeric_converted"),
        F.array(*[F.lit(c) for c in plan.dates]).cast("array<string>").alias("date_converted"),
        (empty * kept).alias("remaining_missing"),
        kept.alias("rows_after_cleaning"),
    )
