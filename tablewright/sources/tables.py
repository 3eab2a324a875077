"""Matrix export: CSV plus Markdown lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..operators.correlation import pivot_matrix


def markdown_rows(wide: DataFrame) -> DataFrame:
    """One Markdown table line per row of a wide matrix."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in wide.columns]
    return wide.select("column", F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


def matrix_export(matrix: DataFrame, columns: Sequence[str], path: str) -> DataFrame:
    """Write a long matrix as wide CSV and as Markdown, and return the CSV as read back."""
    wide = pivot_matrix(matrix, columns)
    wide.write.mode("overwrite").option("header", True).csv(f"{path}/csv")
    header = "| " + " | ".join(["column", *columns]) + " |"
    rule = "|" + " --- |" * (len(columns) + 1)
    lines = markdown_rows(wide).select(F.lit(2).alias("part"), "column", F.col("line"))
    head = wide.sparkSession.createDataFrame([(0, "", header), (1, "", rule)], "part int, column string, line string")
    # A matrix has one line per column of the table, so one ordered file is bounded by the schema.
    head.unionByName(lines).orderBy("part", "column").coalesce(1).select("line").write.mode("overwrite").text(f"{path}/markdown")
    return wide.sparkSession.read.schema(wide.schema).option("header", True).csv(f"{path}/csv")
