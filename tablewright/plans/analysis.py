"""Whole-table analysis: profile, clean, profile again, and the exported tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import numeric_columns
from ..operators import clean, correlation, eda, profile
from ..session import stage


@dataclass
class Analysis:
    raw: DataFrame
    profile: DataFrame
    cleaned: DataFrame
    cleaning_report: DataFrame
    cleaned_profile: DataFrame


def analyze_dataset(df: DataFrame, order_by: Sequence[str] | None = None) -> Analysis:
    """Profile, clean and profile again. The cleaned table is written once and read by all that follows."""
    plan = clean.plan_cleaning(df, order_by)
    cleaned = stage(clean.clean_dataset(df, plan), "cleaned")
    return Analysis(
        df, profile.column_profile(df, order_by), cleaned, clean.cleaning_report(df, plan, cleaned=cleaned), profile.column_profile(cleaned, order_by)
    )


def eda_export(cleaned: DataFrame, raw: DataFrame, root: str, run_id: str) -> DataFrame:
    """Write the tables behind the exploratory plots of one run; returns (table, rows)."""
    tables = {"missing": profile.missing_summary(raw)}
    numbers = numeric_columns(cleaned)
    if len(numbers) >= 2:
        tables["correlation"] = correlation.corr_matrix(cleaned, numbers)
    if numbers:
        tables["histogram"] = eda.histogram(cleaned, numbers)
        tables["boxplot"] = eda.boxplot_stats(cleaned, numbers)
        tables["outliers"] = eda.boxplot_outliers(cleaned, numbers)
    spark, listed = cleaned.sparkSession, []
    for name, table in tables.items():
        path = f"{root.rstrip('/')}/{name}"
        rows = table.withColumn("run_id", F.lit(run_id))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)
        found = spark.read.schema(rows.schema).parquet(path).where(F.col("run_id") == run_id)
        listed.append((name, found.count()))
    return spark.createDataFrame(listed, "table string, rows bigint")
