"""Column kinds, missing values and text parsing shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F, types as T

# Text read as missing by the CSV reader being matched.
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Date layouts tried on text, month-first before day-first.
DATE_FORMATS = [
    "yyyy-MM-dd",
    "yyyy-MM-dd HH:mm:ss",
    "yyyy-MM-dd'T'HH:mm:ss",
    "yyyy/MM/dd",
    "yyyyMMdd",
    "yyyy",
    "MM/dd/yyyy",
    "MM-dd-yyyy",
    "dd/MM/yyyy",
    "dd-MM-yyyy",
    "dd.MM.yyyy",
    "MMM d, yyyy",
    "d MMM yyyy",
    "d-MMM-yyyy",
    "yyyy-MM-dd HH:mm",
    "yyyy-MM-dd'T'HH:mm",
    "yyyy-MM-dd HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
    "yyyy-MM-dd'T'HH:mm:ssXXX",
    "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "MM/dd/yyyy HH:mm",
    "MM/dd/yyyy HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "MM/dd/yy",
    "dd/MM/yy",
]

NUMBER_PATTERN = r"^\s*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?\s*$"
INTEGER_PATTERN = r"^\s*[+-]?[0-9]+\s*$"

NUMERICAL, CATEGORICAL, DATETIME, BOOLEAN, OTHER = (
    "numerical", "categorical", "datetime", "boolean", "other",
)


def quoted(name: str) -> Column:
    """Column by its literal name, dots and spaces included."""
    return F.col("`" + name.replace("`", "``") + "`")


def kind_of(data_type: T.DataType) -> str:
    if isinstance(data_type, T.NumericType):
        return NUMERICAL
    if isinstance(data_type, (T.StringType, T.CharType, T.VarcharType)):
        return CATEGORICAL
    if isinstance(data_type, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return DATETIME
    if isinstance(data_type, T.BooleanType):
        return BOOLEAN
    return OTHER


def columns_of_kind(df: DataFrame, *kinds: str) -> list[str]:
    return [f.name for f in df.schema.fields if kind_of(f.dataType) in kinds]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_kind(df, NUMERICAL)


def is_missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a floating-point column."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return c.isNull() | F.isnan(c)
    return c.isNull()


def present(df: DataFrame, name: str) -> Column:
    """The value, with NaN turned into null."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(c), c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return present(df, name).cast("double")


def parse_number(text: Column) -> Column:
    """Number in text after removing thousands separators, percent, currency and plus signs."""
    bare = F.regexp_replace(text, "[,%$+]", "")
    return F.when(bare.rlike(NUMBER_PATTERN), bare.try_cast("double"))


def parse_date(text: Column, formats: list[str]) -> Column:
    """First layout that parses; null when none does."""
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def as_timestamp(df: DataFrame, name: str, formats: list[str] | None = None) -> Column:
    """Date, timestamp or text column as a zone-free timestamp."""
    if kind_of(df.schema[name].dataType) == DATETIME:
        return quoted(name).cast("timestamp_ntz")
    return parse_date(quoted(name).cast("string"), formats or DATE_FORMATS)


def display_text(df: DataFrame, name: str) -> Column:
    """Value as text whose order is the value's order for text, dates and booleans."""
    data_type = df.schema[name].dataType
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType)):
        return F.date_format(quoted(name), "yyyy-MM-dd HH:mm:ss.SSSSSS")
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(quoted(name))
    return quoted(name).cast("string")


def hash_text(*keys: Column) -> Column:
    """Eight hex digits fixed by a row's key alone, spread evenly."""
    return F.substring(F.md5(F.concat_ws("|", *[k.cast("string") for k in keys])), 1, 8)


def hash_below(fraction: float, *keys: Column) -> Column:
    """True for about ``fraction`` of the rows, always the same ones."""
    return hash_text(*keys) < F.lit(f"{int(fraction * 2**32):08x}")


def sanitized_name(text: Column) -> Column:
    """Warehouse-safe form of a column name held in a text column."""
    c = F.replace(F.replace(text, F.lit("R²"), F.lit("r2")), F.lit("%"), F.lit("pct"))
    c = F.replace(F.lower(c), F.lit(" "), F.lit("_"))
    c = F.regexp_replace(F.regexp_replace(c, "[^a-z0-9_]", ""), "_+", "_")
    return F.trim(c, F.lit("_"))


def sanitize_names(names: list[str]) -> list[str]:
    """Warehouse-safe names for a schema; a repeated name gets a numeric suffix."""
    out: list[str] = []
    for name in names:
        n = name.replace("R²", "r2").replace("%", "pct").lower().replace(" ", "_")
        n = re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "", n)).strip("_")
        unique, i = n, 2
        while unique in out:
            unique, i = f"{n}_{i}", i + 1
        out.append(unique)
    return out
