"""Task detection, forecast suitability and rule-based sentences.

All of these are rules over the column profile, a table with one row per
column, and are evaluated for every candidate target at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DATETIME, as_timestamp, columns_of_kind
from ..functions.tables import union_all

MAX_CLASSES = 20


def _is_date() -> Column:
    return F.col("is_date_candidate") | (F.col("kind") == DATETIME)


def _is_number() -> Column:
    return F.col("kind").isin("numerical", "boolean")


def detect_task(profile: DataFrame) -> DataFrame:
    """Task for every column taken as target; ``is_default`` marks the first column that is no date."""
    whole = Window.partitionBy()  # one row per column of the table
    dates = F.sum(_is_date().cast("int")).over(whole)
    columns = F.count(F.lit(1)).over(whole)
    task = (
        F.when(_is_date(), "unknown")
        .when(_is_number() & (dates >= 1) & (dates == columns - 1), "forecasting")
        .when((F.col("kind") == "categorical") & ~F.col("is_high_cardinality"), "classification")
        .when(_is_number() & (F.col("unique") <= MAX_CLASSES), "classification")
        .when(_is_number(), "regression")
        .otherwise("unknown")
    )
    first = F.min(F.when(~_is_date(), F.col("ordinal"))).over(whole)
    return profile.select(
        F.col("column").alias("target"), task.alias("task"),
        (F.col("ordinal") == F.coalesce(first, F.lit(0))).alias("is_default"), "kind", "rows", "unique",
    )


def task_metadata(tasks: DataFrame) -> DataFrame:
    """Confidence and reason for each detected task. The sentences are fixed values."""
    unique, rows, target = F.col("unique"), F.col("rows"), F.col("target")
    text = F.col("kind") == "categorical"
    classification = F.col("task") == "classification"
    reason = (
        F.when(classification & text, F.format_string("Target column '%s' is categorical with %d unique values.", target, unique))
        .when(
            classification & (unique <= 5),
            F.format_string("Target column '%s' contains only %d unique numeric values, treated as class labels.", target, unique),
        )
        .when(
            classification,
            F.format_string(
                "Target column '%s' contains %d unique values and was classified using the low-cardinality rule (≤20 unique).",
                target, unique,
            ),
        )
        .when(
            F.col("task") == "regression",
            F.format_string("Target column '%s' is numeric with %d unique values out of %d rows.", target, unique, rows),
        )
        .when(
            F.col("task") == "forecasting",
            F.format_string("Target column '%s' is numeric and the dataset structure indicates a time-series.", target),
        )
        .otherwise(F.format_string("Could not determine a supported task type for target '%s'.", target))
    )
    confidence = (
        F.when(classification, F.when(text | (unique <= 5), "High").otherwise("Medium"))
        .when(F.col("task") == "regression", F.when(F.try_divide(unique, rows) > 0.5, "High").otherwise("Medium"))
        .when(F.col("task") == "forecasting", "Medium")
        .otherwise("Low")
    )
    return tasks.select("target", "task", confidence.alias("confidence"), reason.alias("reason"))


def date_uniques(df: DataFrame, formats: dict[str, str]) -> DataFrame:
    """Distinct parsed values per date column: datetime columns and text columns with a known layout."""
    names = columns_of_kind(df, DATETIME) + [c for c in df.columns if c in formats]
    branches = [
        df.select(as_timestamp(df, c, [formats[c]] if c in formats else None).alias("ds"))
        .where("ds is not null").distinct().agg(F.count(F.lit(1)).alias("unique_dates"))
        .select(F.lit(c).alias("column"), "unique_dates")
        for c in names
    ]
    if not branches:
        return df.sparkSession.createDataFrame([], "column string, unique_dates long")
    return union_all(branches)


def forecast_suitability(profile: DataFrame, uniques: DataFrame) -> DataFrame:
    """Suitability of every target: the date column with most distinct values decides, names break ties."""
    targets = profile.select(F.col("column").alias("target"), _is_number().alias("numeric"))
    # One row per column on both sides; each target needs the best date column other than itself.
    ranked = uniques.where("unique_dates > 0").agg(
        F.sort_array(F.collect_list(F.struct((-F.col("unique_dates")).alias("order"), "column"))).alias("best")
    )
    dates = uniques.agg(F.sort_array(F.collect_list("column")).alias("dates"))
    joined = targets.withColumn("k", F.lit(1)).join(ranked.withColumn("k", F.lit(1)), "k").join(dates.withColumn("k", F.lit(1)), "k")
    others = F.filter("best", lambda b: b["column"] != F.col("target"))
    pick = joined.select(
        "target", "numeric",
        F.size(F.filter("dates", lambda d: d != F.col("target"))).alias("candidates"),
        F.get(others, F.lit(0)).alias("pick"),
    ).select("target", "numeric", "candidates", F.col("pick.column").alias("date_column"), (-F.col("pick.order")).alias("observations"))
    n = F.coalesce("observations", F.lit(0))
    usable = F.col("numeric") & (F.col("candidates") > 0) & (n >= 10)
    level = F.when(usable & (n >= 100), "High").when(usable & (n >= 30), "Medium").otherwise("Low")
    reason = (
        F.when(
            ~F.col("numeric"),
            F.format_string("Target column '%s' is not numeric. Forecasting requires a numeric target.", F.col("target")),
        )
        .when(
            F.col("candidates") == 0,
            "No datetime column detected in the dataset. Forecasting requires at least one datetime column.",
        )
        .when(n < 10, "Datetime information exists but does not appear to represent a continuous time series.")
        .otherwise(
            F.format_string(
                "Datetime column detected: %s. Numeric target selected: %s. %d chronological observations available.",
                F.col("date_column"), F.col("target"), n,
            )
        )
    )
    return pick.select("target", level.alias("suitability"), reason.alias("reason"), F.when(usable, F.col("date_column")).alias("date_column"))


def _sentences(row: DataFrame, category: str, sentences: Sequence[Column]) -> DataFrame:
    said = F.filter(F.array(*sentences), lambda s: s.isNotNull())
    return row.select(F.posexplode(said).alias("position", "insight")).select(F.lit(category).alias("category"), "position", "insight")


def _first_names(names: Column) -> Column:
    """The first three names, with dots when there are more."""
    return F.concat(F.array_join(F.slice(names, 1, 3), ", "), F.when(F.size(names) > 3, "...").otherwise(""))


def _names(flag: Column) -> Column:
    """Names of the flagged columns in table order; one entry per column of the table."""
    flagged = F.collect_list(F.when(flag, F.struct("ordinal", "column")))
    return F.transform(F.sort_array(flagged), lambda s: s["column"])


def insights_dataset(profile: DataFrame, summary: DataFrame, report: DataFrame) -> DataFrame:
    """Sentences on size, duplicates, missing values and high cardinality."""
    high = profile.agg(_names(F.col("is_high_cardinality")).alias("high"))
    row = summary.withColumn("k", F.lit(1)).join(report.withColumn("k", F.lit(1)), "k").join(high.withColumn("k", F.lit(1)), "k")
    missing = F.col("total_missing")
    return _sentences(
        row,
        "dataset",
        [
            F.when(
                (F.col("rows") > 0) & (F.col("columns") > 0),
                F.format_string("The dataset contains %d rows and %d columns.", F.col("rows"), F.col("columns")),
            ),
            F.when(
                F.col("duplicates_removed") > 0,
                F.format_string("Removed %d duplicate rows to improve data quality.", F.col("duplicates_removed")),
            ),
            F.when(missing > 0, F.format_string("Detected %d missing values initially.", missing)).otherwise(
                "The dataset is completely free of missing values."
            ),
            F.when((missing > 0) & (F.col("remaining_missing") == 0), "All missing values were successfully imputed."),
            F.when(
                F.size("high") > 0,
                F.format_string("High-cardinality columns detected (many unique values): %s.", _first_names(F.col("high"))),
            ),
        ],
    )


def insights_eda(profile: DataFrame, report: DataFrame) -> DataFrame:
    """Sentences on column kinds, binary columns and conversions."""
    facts = profile.agg(
        F.count_if(F.col("kind") == "numerical").alias("numbers"),
        F.count_if(F.col("kind") == "categorical").alias("categories"),
        _names(F.col("is_binary")).alias("binary"),
    )
    row = facts.withColumn("k", F.lit(1)).join(report.withColumn("k", F.lit(1)), "k")
    return _sentences(
        row,
        "eda",
        [
            F.format_string(
                "Feature breakdown: %d numerical features and %d categorical features.", F.col("numbers"), F.col("categories")
            ),
            F.when(
                F.size("binary") > 0, F.format_string("Binary/Boolean features identified: %s.", _first_names(F.col("binary")))
            ),
            F.when(
                F.size("date_converted") > 0,
                F.format_string("Automatically parsed datetime features: %s.", F.array_join("date_converted", ", ")),
            ),
            F.when(
                F.size("numeric_converted") > 0,
                F.format_string(
                    "Cleaned and converted text columns to numeric: %s.", F.array_join(F.slice("numeric_converted", 1, 3), ", ")
                ),
            ),
        ],
    )


def insights_model(best: DataFrame) -> DataFrame:
    """Sentences on the winning model, from its row of the metrics table."""
    have = set(best.columns)

    def said(name: str, sentence: str, value: Column) -> Column:
        if name not in have:
            return F.lit(None).cast("string")
        return F.when(F.col(name).isNotNull(), F.format_string(sentence, value))

    def scaled(name: str, factor: float) -> Column:
        return F.col(name) * factor if name in have else F.lit(None).cast("double")

    return _sentences(
        best,
        "model",
        [
            F.format_string("The %s algorithm achieved the highest overall performance.", F.col("model")),
            said("accuracy", "The model successfully predicts the correct category %.1f%% of the time.", scaled("accuracy", 100.0)),
            said("f1", "F1 Score (balance of precision and recall) is %.3f.", scaled("f1", 1.0)),
            said("r2", "The model explains %.1f%% of the variance in the target variable.", scaled("r2", 100.0)),
            said(
                "rmse", "The Root Mean Squared Error (RMSE) is %.3f, indicating the average prediction error.", scaled("rmse", 1.0)
            ),
        ],
    )
