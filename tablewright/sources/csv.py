"""CSV in and out: scan, missing tokens, type promotion, sink."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import CATEGORICAL, INTEGER_PATTERN, NA_TOKENS, NUMBER_PATTERN, columns_of_kind, quoted
from . import records

BOOLEAN_WORDS = ["true", "false"]
COLUMNS_PER_PASS = 20


def csv_scan(spark: SparkSession, path: str, schema: T.StructType | str | None = None, multiline: bool | None = None) -> DataFrame:
    """Headered CSV, all columns text unless a schema is given.

    Line breaks inside quotes are found by one pass over the lines; a table that has none is read as lines, any other
    by its records, which many tasks put together. ``multiline`` false leaves the pass out, for tables known to have no such break;
    true leaves the work to the engine's reader of whole files, one task each.
    """
    options = {"header": "true", "escape": '"', "mode": "PERMISSIVE"}
    reader = spark.read.options(**options).option("multiLine", multiline is not False)
    reader = reader.schema(schema) if schema is not None else reader
    if multiline is None:
        if records.breaks_in_quotes(spark, path):
            return records.parsed(records.records(spark, path), reader.csv(path).schema, options | {"multiLine": "true", "header": "false"})
        reader = reader.option("multiLine", False)
    return reader.csv(path)


def na_token_normalise(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Text that stands for a missing value becomes null."""
    names = list(columns if columns is not None else columns_of_kind(df, CATEGORICAL))
    return df.withColumns({c: F.when(~quoted(c).isin(NA_TOKENS), quoted(c)) for c in names})


def fit_column_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Narrowest of bigint, double, boolean, string that holds every value of a text column.

    A column without values is double; booleans must be complete, as a missing
    one leaves a column of mixed objects in the behaviour being matched.
    """
    names = list(columns if columns is not None else columns_of_kind(df, CATEGORICAL))
    out: dict[str, str] = {}
    for i in range(0, len(names), COLUMNS_PER_PASS):
        batch = names[i : i + COLUMNS_PER_PASS]
        aggs = [F.count(F.lit(1)).alias("rows")]
        for k, c in enumerate(batch):
            x = quoted(c)
            whole = x.rlike(INTEGER_PATTERN) & F.trim(x).try_cast("bigint").isNotNull()
            aggs += [
                F.count(x).alias(f"n{k}"), F.count_if(whole).alias(f"i{k}"), F.count_if(x.rlike(NUMBER_PATTERN)).alias(f"d{k}"),
                F.count_if(F.lower(x).isin(BOOLEAN_WORDS)).alias(f"b{k}"),
            ]
        row = df.agg(*aggs).first()
        for k, c in enumerate(batch):
            n = row[f"n{k}"]
            if n == 0:
                out[c] = "double"
            elif row[f"i{k}"] == n:
                out[c] = "bigint"
            elif row[f"d{k}"] == n:
                out[c] = "double"
            elif row[f"b{k}"] == n == row["rows"]:
                out[c] = "boolean"
            else:
                out[c] = "string"
    return out


def infer_column_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    fitted = fit_column_types(df, columns)
    return df.withColumns({c: F.trim(quoted(c)).try_cast(t) for c, t in fitted.items() if t != "string"})


def read_table(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """CSV with missing tokens and types settled."""
    return infer_column_types(na_token_normalise(csv_scan(spark, path, multiline=multiline)))


def preview_head(df: DataFrame, rows: int = 5, order_by: Sequence[str] | None = None) -> DataFrame:
    return (df.orderBy(*order_by) if order_by else df).limit(rows)


def csv_sink(df: DataFrame, path: str) -> bool:
    """Write as headered CSV, blanks at the ends of values kept; true when the result holds at least one row."""
    blanks = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    df.write.mode("overwrite").options(header="true", escape='"', **blanks).csv(path)
    return not csv_scan(df.sparkSession, path, df.schema, multiline=False).isEmpty()  # one line tells
