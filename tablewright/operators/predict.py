"""Prediction input checks, scoring and summaries."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import quoted
from ..functions.quantiles import exact_quantiles


class PredictionValidationError(Exception):
    """Input lacks columns the model was trained on."""


def validate_prediction_schema(df: DataFrame, features: T.StructType) -> DataFrame:
    """Training columns in training order and type; extra columns are dropped, missing ones are an error."""
    if not features.fields:
        raise ValueError("the stored feature schema has no columns")
    missing = [f.name for f in features.fields if f.name not in df.columns]
    if missing:
        raise PredictionValidationError("missing feature columns: " + ", ".join(missing))
    return df.select(*[quoted(f.name).cast(f.dataType).alias(f.name) for f in features.fields])


def score(model: PipelineModel, df: DataFrame, features: T.StructType) -> DataFrame:
    """Feature columns with the model's prediction, decoded to the original label for classes."""
    scored = model.transform(validate_prediction_schema(df, features))
    output = "predicted_label" if "predicted_label" in scored.columns else "prediction"
    return scored.select(*[quoted(f.name) for f in features.fields], F.col(output).alias("Prediction"))


def prediction_sample(scored: DataFrame, rows: int = 10) -> DataFrame:
    return scored.limit(rows)


def prediction_stats(scored: DataFrame, column: str = "Prediction") -> DataFrame:
    """Minimum, maximum, mean, median and population deviation, four decimals."""
    x = quoted(column).cast("double")
    median = exact_quantiles(scored, {"x": x}, [0.5])["x"][0]
    stats = scored.agg(F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"))
    return stats.select(
        *[F.round(c, 4).alias(c) for c in ("min", "max", "mean")], F.round(F.lit(median).cast("double"), 4).alias("median"),
        F.round("std", 4).alias("std"),
    )


def class_distribution(scored: DataFrame, column: str = "Prediction") -> DataFrame:
    return (
        scored.groupBy(quoted(column).cast("string").alias("class")).agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), "class")
    )


def prediction_summary(scored: DataFrame, source: str, location: str, task: str, column: str = "Prediction") -> DataFrame:
    """Source, count, location and statistics as one record."""
    if task == "classification":
        # One entry per class.
        stats = class_distribution(scored, column).agg(
            F.sum("count").alias("count"),
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("class", "count")))).alias("statistics"),
        )
    else:
        row = prediction_stats(scored, column).withColumn("k", F.lit(1))
        count = scored.agg(F.count(F.lit(1)).alias("count")).withColumn("k", F.lit(1))
        entries = [x for c in ("min", "max", "mean", "median", "std") for x in (F.lit(c), F.col(c))]
        stats = count.join(row, "k").select("count", F.create_map(*entries).alias("statistics"))
    return stats.select(F.lit(source).alias("source"), "count", F.lit(location).alias("file_location"), "statistics")
