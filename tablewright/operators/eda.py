"""Exploratory statistics: summaries, histograms, box plots, densities, samples."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.columns import NUMERICAL, as_double, columns_of_kind, hash_text, is_missing, kind_of, numeric_columns, quoted
from ..functions.quantiles import exact_quantiles
from ..functions.tables import batches, one_row_to_long, union_all, wide_to_long
from . import clean, profile

BINS = 30
QUARTILES = [0.25, 0.5, 0.75]
MOMENT_COLUMNS = 12  # columns per aggregate, to stay within generated code


def _moments(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long table of count, mean, sample deviation, minimum and maximum per numeric column."""
    parts = []
    for names in batches(list(columns), MOMENT_COLUMNS):
        aggs, entries = [], []
        for i, c in enumerate(names):
            x = as_double(df, c)
            aggs += [
                F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.stddev_samp(x).alias(f"s{i}"),
                F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}"),
            ]
            entries.append(
                {"column": F.lit(c), "mean": F.col(f"a{i}"), "std": F.col(f"s{i}"), "min": F.col(f"l{i}"), "max": F.col(f"h{i}")}
            )
        parts.append(one_row_to_long(df.agg(*aggs), entries))
    return union_all(parts)


def fit_quartiles(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, list[float | None]]:
    if not columns:
        return {}
    if not exact:
        row = df.agg(
            *[F.percentile_approx(as_double(df, c), QUARTILES, 10000).alias(f"q{i}") for i, c in enumerate(columns)]
        ).first()
        return {c: row[f"q{i}"] or [None] * 3 for i, c in enumerate(columns)}
    return exact_quantiles(df, {c: as_double(df, c) for c in columns}, QUARTILES)


def _literal_rows(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _quartile_rows(df: DataFrame, columns: Sequence[str], exact: bool) -> DataFrame:
    found = fit_quartiles(df, columns, exact)
    return _literal_rows(
        df, [(c, *found[c]) for c in columns], "column string, p25 double, p50 double, p75 double"
    )


def _counts(df: DataFrame) -> DataFrame:
    entries = [
        {
            "column": F.lit(f.name), "ordinal": F.lit(i), "type": F.lit(f.dataType.simpleString()),
            "count": F.col("rows") - F.col(f"m{i}"), "missing_count": F.col(f"m{i}"),
            "missing_pct": F.try_divide(F.col(f"m{i}").cast("double"), F.col("rows")) * 100,
        }
        for i, f in enumerate(df.schema.fields)
    ]
    return one_row_to_long(profile.missing_counts(df), entries)


STATISTICS = ["mean", "std", "min", "p25", "p50", "p75", "max"]


def _describe(df: DataFrame, unique_for_numbers: bool, exact: bool) -> DataFrame:
    numbers = numeric_columns(df)
    others = [c for c in df.columns if c not in numbers]
    out = _counts(df)
    if numbers:
        stats = _moments(df, numbers).join(_quartile_rows(df, numbers, exact), "column")
        out = out.join(stats, "column", "left")
    else:
        out = out.withColumns({s: F.lit(None).cast("double") for s in STATISTICS})
    frequent = []
    if others:
        frequent.append(profile.most_frequent(df, others))
    if numbers and unique_for_numbers:
        frequent.append(
            profile.unique_values(df, numbers, exact).select(
                "column", F.lit(None).cast("string").alias("top"), F.lit(None).cast("long").alias("freq"), "unique"
            )
        )
    if frequent:
        return out.join(union_all(frequent), "column", "left")
    return out.withColumns(
        {"top": F.lit(None).cast("string"), "freq": F.lit(None).cast("long"), "unique": F.lit(None).cast("long")}
    )


def summary_statistics(df: DataFrame, exact: bool = True) -> DataFrame:
    """Type, counts and distinct values per column; moments and quartiles for numbers, top and freq for the rest."""
    return _describe(df, True, exact).select(
        "column", "ordinal", "type", "count", "missing_count", "missing_pct", "unique", *STATISTICS, "top", "freq"
    )


def describe_all(df: DataFrame, exact: bool = True) -> DataFrame:
    """Count, unique, top, freq, moments and quartiles; null where a statistic does not apply."""
    return _describe(df, False, exact).select("column", "ordinal", "count", "unique", "top", "freq", *STATISTICS)


def top_freq(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    names = columns if columns is not None else [c for c in df.columns if kind_of(df.schema[c].dataType) != NUMERICAL]
    return profile.most_frequent(df, names).select("column", "top", "freq")


def fit_ranges(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Minimum and maximum of each column that has values."""
    row = df.agg(*[F.struct(F.min(as_double(df, c)), F.max(as_double(df, c))).alias(f"r{i}") for i, c in enumerate(columns)]).first()
    return {c: tuple(row[f"r{i}"]) for i, c in enumerate(columns) if row[f"r{i}"][0] is not None}


def histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Counts in equal-width bins per numeric column, the last bin closed, empty bins included."""
    names = [c for c in (columns if columns is not None else df.columns) if c in numeric_columns(df)]
    ranges = fit_ranges(df, names) if names else {}
    if not ranges:
        return _literal_rows(df, [], "column string, bin int, lower double, upper double, count long")
    places, edges = {}, []
    for c, (low, high) in ranges.items():
        width = (high - low) / bins
        x = as_double(df, c)
        place = F.least(F.floor((x - F.lit(low)) / F.lit(width)), F.lit(bins - 1)) if width else F.lit(0)
        places[c] = F.when(x.isNotNull(), place).cast("int")
        edges.append((c, low, width))
    counted = wide_to_long(df, places, value="bin").groupBy("column", "bin").agg(F.count(F.lit(1)).alias("n"))
    grid = (
        _literal_rows(df, edges, "column string, low double, width double")
        .withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
        .select("column", "bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lower"),
                (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("upper"))
    )
    return grid.join(counted, ["column", "bin"], "left").select(
        "column", "bin", "lower", "upper", F.coalesce("n", F.lit(0)).cast("long").alias("count")
    )


def skewness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Bias-corrected skewness; 0 for a constant column, null below three values."""
    names = list(columns if columns is not None else numeric_columns(df))
    aggs, entries = [], []
    for i, c in enumerate(names):
        x = as_double(df, c)
        n = F.col(f"n{i}").cast("double")
        aggs += [F.count(x).alias(f"n{i}"), F.skewness(x).alias(f"g{i}"), (F.min(x) == F.max(x)).alias(f"same{i}")]
        corrected = F.when(n >= 3, F.when(F.col(f"same{i}"), 0.0).otherwise(F.col(f"g{i}") * F.sqrt(n * (n - 1)) / (n - 2)))
        entries.append({"column": F.lit(c), "skewness": corrected})
    return one_row_to_long(df.agg(*aggs), entries)


def log_histogram(df: DataFrame, columns: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """Histogram with the logarithm of the counts for columns whose skewness exceeds 1 in size."""
    skewed = [r["column"] for r in skewness(df, columns).filter(F.abs("skewness") > 1.0).collect()]
    counts = histogram(df, skewed, bins)
    return counts.select(
        F.concat("column", F.lit("_log")).alias("column"), "bin", "lower", "upper", "count",
        F.when(F.col("count") > 0, F.log10("count")).alias("log_count"),
    )


def fit_fences(df: DataFrame, columns: Sequence[str], exact: bool = True) -> dict[str, tuple[float, float, float, float, float]]:
    """Quartiles with the fences 1.5 interquartile ranges outside them."""
    out = {}
    for c, (q1, q2, q3) in fit_quartiles(df, columns, exact).items():
        if q1 is not None:
            out[c] = (q1, q2, q3, q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1))
    return out


def boxplot_stats(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Quartiles, fences, and whiskers at the outermost points inside the fences."""
    fences = fit_fences(df, list(columns if columns is not None else numeric_columns(df)), exact)
    aggs, entries = [], []
    for i, (c, (q1, q2, q3, low, high)) in enumerate(fences.items()):
        x = as_double(df, c)
        inside = F.when((x >= low) & (x <= high), x)
        aggs += [F.min(inside).alias(f"l{i}"), F.max(inside).alias(f"h{i}"), F.count_if((x < low) | (x > high)).alias(f"o{i}")]
        entries.append(
            {
                "column": F.lit(c), "q1": F.lit(q1), "median": F.lit(q2), "q3": F.lit(q3),
                "lower_fence": F.lit(low), "upper_fence": F.lit(high),
                "lower_whisker": F.col(f"l{i}"), "upper_whisker": F.col(f"h{i}"), "outliers": F.col(f"o{i}"),
            }
        )
    return one_row_to_long(df.agg(*aggs), entries)


def boxplot_outliers(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """(column, value) of every point outside its column's fences."""
    fences = fit_fences(df, list(columns if columns is not None else numeric_columns(df)), exact)
    outside = {}
    for c, (_, _, _, low, high) in fences.items():
        x = as_double(df, c)
        outside[c] = F.when((x < low) | (x > high), x)
    return wide_to_long(df, outside)


def missing_pattern_sample(df: DataFrame, key: Sequence[str], max_samples: int = 200) -> DataFrame:
    """0/1 missing indicators of a repeatable sample of rows, for the columns that have missing values."""
    names = clean.incomplete_columns(df, [c for c in df.columns if c not in key])
    position = hash_text(*[quoted(k) for k in key])
    sample = df.withColumn("__position", position).orderBy("__position", *key).limit(max_samples)
    return sample.select(*key, *[is_missing(df, c).cast("int").alias(c) for c in names])


def class_counts(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(quoted(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("count")).where("value is not null")


def target_distribution(df: DataFrame, target: str, bins: int = BINS) -> DataFrame:
    """Histogram of a numeric target, count per class otherwise."""
    if target in columns_of_kind(df, NUMERICAL):
        return histogram(df, [target], bins)
    return class_counts(df, target)


def kde(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """Gaussian density on an even grid over the data range, Scott's bandwidth.

    Equal values are counted first, so the grid multiplies distinct values only
    and the products are summed before they leave their task.
    """
    x = as_double(df, column)
    n, deviation, low, high = df.agg(F.count(x), F.stddev_samp(x), F.min(x), F.max(x)).first()
    if n < 2 or not deviation:
        return _literal_rows(df, [], "point int, x double, density double")
    width = deviation * n ** (-0.2)
    step = (high - low) / (points - 1)
    values = profile.value_counts(df, column).select(F.col("value").cast("double").alias("value"), "n")
    terms = values.select(F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("point"), "value", "n")
    at = F.lit(low) + F.col("point") * F.lit(step)
    z = (at - F.col("value")) / F.lit(width)
    total = F.sum(F.col("n") * F.exp(-0.5 * z * z))
    return terms.groupBy("point").agg((total / F.lit(n * width * math.sqrt(2 * math.pi))).alias("density")).select(
        "point", at.alias("x"), "density"
    )
