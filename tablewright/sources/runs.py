"""Run documents: event log, history table, document scan."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# A new run's document.
RUN_DEFAULTS = {
    "task_type": None,
    "target_column": None,
    "best_model": None,
    "prediction_count": 0,
    "forecast_enabled": False,
    "forecast_horizon": None,
    "eda_pdf": None,
    "training_pdf": None,
    "prediction_pdf": None,
    "forecast_pdf": None,
}

SYNC_TYPE = "struct<status:string,rows:bigint,uploaded_at:string,table:string,reason:string,error:string>"

RUN_SCHEMA = (
    "run_id string, dataset_name string, run_timestamp string, task_type string, target_column string, best_model string, "
    "prediction_count bigint, forecast_enabled boolean, forecast_horizon int, eda_pdf string, training_pdf string, "
    "prediction_pdf string, forecast_pdf string, artifacts map<string,string>, "
    + ", ".join(f"bq_{k} {SYNC_TYPE}" for k in ("uploaded_dataset", "cleaned_dataset", "metrics", "forecast"))
)


def run_log_merge(events: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One document per run from its events (run_id, seq, fields...): the last value given wins, per field."""
    names = list(fields if fields is not None else [c for c in events.columns if c not in ("run_id", "seq")])
    merged = []
    for name in names:
        last = F.max_by(F.col(name), F.when(F.col(name).isNotNull(), F.col("seq")))
        default = RUN_DEFAULTS.get(name)
        merged.append((F.coalesce(last, F.lit(default)) if default is not None else last).alias(name))
    return events.groupBy("run_id").agg(*merged)


def sync_text(status: Column) -> Column:
    """Display form of a write's outcome."""
    text = F.coalesce(status["status"], F.lit("Unknown"))
    rows = F.coalesce(status["rows"].cast("string"), F.lit("?"))
    return (
        F.when(status.isNull(), "N/A")
        .when(text == "Uploaded", F.concat(F.lit("✓ ("), rows, F.lit(" rows)")))
        .when(text == "Skipped", "Skipped")
        .otherwise(F.concat(F.lit("✗ "), text))
    )


def _or_default(df: DataFrame, name: str, default: str, empty_too: bool) -> Column:
    if name not in df.columns:
        return F.lit(default)
    c = F.col(name)
    return F.coalesce(F.when(c != "", c) if empty_too else c, F.lit(default))


SYNCED = {
    "sync_dataset": "bq_uploaded_dataset", "sync_cleaned": "bq_cleaned_dataset", "sync_metrics": "bq_metrics",
    "sync_forecast": "bq_forecast",
}
DOCUMENTS = ["eda_pdf", "training_pdf", "prediction_pdf", "forecast_pdf"]


def run_history(runs: DataFrame) -> DataFrame:
    """All runs as a display table, newest first."""
    stamp = F.col("run_timestamp").cast("string")
    shown = F.coalesce(F.date_format(stamp.try_cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss"), stamp, F.lit(""))
    have = set(runs.columns)
    return runs.select(
        "run_id",
        _or_default(runs, "dataset_name", "Unknown", False).alias("dataset"),
        _or_default(runs, "task_type", "Pending", True).alias("task"),
        _or_default(runs, "best_model", "Pending", True).alias("model"),
        shown.alias("timestamp"),
        *[(F.col(c) if c in have else F.lit(None).cast("string")).alias(c) for c in DOCUMENTS],
        *[(sync_text(F.col(c)) if c in have else F.lit("N/A")).alias(name) for name, c in SYNCED.items()],
    ).orderBy(F.desc("timestamp"), "run_id")


def run_metadata_scan(spark: SparkSession, root: str, pattern: str = "*/metadata.json", multiline: bool = True) -> DataFrame:
    """Every run document under ``root``; broken documents are left out, unnamed runs take their folder's name."""
    docs = (
        spark.read.schema(f"{RUN_SCHEMA}, _corrupt_record string").option("multiLine", multiline).option("mode", "PERMISSIVE").json(f"{root.rstrip('/')}/{pattern}")
        .withColumn("_folder", F.element_at(F.split(F.input_file_name(), "/"), -2))
    )
    return docs.where("_corrupt_record is null").withColumn("run_id", F.coalesce("run_id", "_folder")).drop("_corrupt_record", "_folder")
