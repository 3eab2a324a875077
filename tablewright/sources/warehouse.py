"""Warehouse tables partitioned by run, with per-run replacement."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from ..functions.columns import quoted, sanitize_names

# The version and the table schemas that the warehouse has.
APP_VERSION = "2.1"

RUN_METADATA = "run_id string, dataset_name string, target_column string, task_type string, best_model string, run_timestamp timestamp, app_version string"
DATASET_PROFILES = (
    "run_id string, dataset_name string, task_type string, target_column string, rows bigint, columns bigint, "
    "missing_values bigint, duplicate_rows bigint, timestamp timestamp, app_version string"
)
TRAINING_METRICS = (
    "run_id string, task_type string, target_column string, best_model string, accuracy double, f1 double, precision double, "
    "recall double, r2 double, rmse double, mae double, timestamp timestamp, app_version string"
)


def sanitize_column_names(df: DataFrame) -> DataFrame:
    return df.toDF(*sanitize_names(df.columns))


def inject_run_columns(
    df: DataFrame, run_id: str | Column | None = None, dataset_name: str | Column | None = None, task_type: str | Column | None = None,
    target_column: str | Column | None = None, created_at: datetime.datetime | None = None, app_version: str = APP_VERSION,
) -> DataFrame:
    """Run columns in front, creation time and version behind."""
    given = {"run_id": run_id, "dataset_name": dataset_name, "task_type": task_type, "target_column": target_column}
    front = [(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in given.items() if v is not None]
    stamp = F.lit(created_at.isoformat()) if created_at else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return df.select(*front, "*", stamp.alias("created_at"), F.lit(app_version).alias("app_version"))


def warehouse_schema_cast(df: DataFrame) -> DataFrame:
    """Integers, floats, booleans and timestamps keep their class; anything else becomes text."""
    out = []
    for f in df.schema.fields:
        c, t = quoted(f.name), f.dataType
        if isinstance(t, T.IntegralType):
            c = c.cast("bigint")
        elif isinstance(t, T.FractionalType):
            c = c.cast("double")
        elif isinstance(t, (T.BooleanType, T.TimestampType, T.TimestampNTZType)):
            pass
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        else:
            c = c.cast("string")
        out.append(c.alias(f.name))
    return df.select(*out)


def iso_text(c: Column) -> Column:
    """ISO 8601 text, with a fraction only when there is one."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss")
    fraction = F.date_format(c, "SSSSSS")
    return F.when(fraction == "000000", whole).otherwise(F.concat_ws(".", whole, fraction))


def normalize_row_values(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The wanted columns, absent ones null: timestamps as ISO text, primitives kept, the rest as text."""
    out = []
    for key in keys:
        if key not in df.columns:
            out.append(F.lit(None).cast("string").alias(key))
            continue
        c, t = quoted(key), df.schema[key].dataType
        if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
            c = iso_text(c)
        elif isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
            c = F.to_json(c)
        elif isinstance(t, T.DecimalType) or not isinstance(t, (T.NumericType, T.StringType, T.BooleanType)):
            c = c.cast("string")
        out.append(c.alias(key))
    return df.select(*out)


def record_hash(df: DataFrame) -> Column:
    """SHA-256 of the record as JSON with its keys in order."""
    return F.sha2(F.to_json(F.struct(*[quoted(c) for c in sorted(df.columns)])), 256)


def record_hash_dedup(df: DataFrame) -> DataFrame:
    """Adds ``row_id`` and keeps one of each set of equal records."""
    return df.withColumn("row_id", record_hash(df)).dropDuplicates(["row_id"])


def replace_by_run(df: DataFrame, path: str) -> None:
    """Write runs so that a run already in the table is replaced and all others stay.

    Each task writes its own files per run: a run that holds most of the rows is
    written by many tasks.
    """
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path)


def read_runs(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def append_dataframe(df: DataFrame, path: str, run_id: str, **run_columns) -> DataFrame:
    """Sanitise, add run columns, cast, deduplicate, replace the run; returns the rows written."""
    named = inject_run_columns(sanitize_column_names(df), run_id=run_id, **run_columns)
    rows = record_hash_dedup(warehouse_schema_cast(named)).drop("row_id")
    replace_by_run(rows, path)
    return read_runs(df.sparkSession, path, rows.schema).where(F.col("run_id") == run_id)


def sync_status(requests: DataFrame, target: DataFrame) -> DataFrame:
    """Outcome per requested write (artifact, run_id): rows found in the target, or skipped when none."""
    counts = target.groupBy("artifact", "run_id").agg(F.count(F.lit(1)).alias("rows"))
    done = F.col("rows").isNotNull()
    return requests.join(counts, ["artifact", "run_id"], "left").select(
        "artifact", "run_id", F.when(done, "Uploaded").otherwise("Skipped").alias("status"), "rows",
        F.when(~done, "empty_dataframe").alias("reason"),
    )


def sync_artifacts(spark: SparkSession, artifacts: dict[str, DataFrame], root: str, run_id: str, **run_columns) -> DataFrame:
    """Write each artifact table and report per artifact: Uploaded with rows and time, Skipped when empty, or Failed."""
    outcome = []
    for name, df in artifacts.items():
        now = datetime.datetime.now(datetime.timezone.utc).replace(tzinfo=None).isoformat()
        if df.isEmpty():
            outcome.append((name, "Skipped", None, None, "empty_dataframe", None))
            continue
        try:
            written = append_dataframe(df, f"{root}/{name}", run_id, **run_columns).count()
            outcome.append((name, "Uploaded", written, now, None, None))
        except Exception as error:  # noqa: BLE001 - the outcome is the report
            outcome.append((name, "Failed", None, now, None, str(error)))
    return spark.createDataFrame(
        outcome, "artifact string, status string, rows bigint, uploaded_at string, reason string, error string"
    )


def fixed_table(df: DataFrame, schema: str) -> DataFrame:
    """Columns of a fixed schema, absent ones null; a row without run_id is an error."""
    out = []
    for f in T.StructType.fromDDL(schema).fields:
        if f.name == "run_id":
            out.append(F.coalesce(quoted("run_id").cast("string"), F.raise_error(F.lit("run_id is required"))).alias("run_id"))
        elif f.name in df.columns:
            out.append(quoted(f.name).cast(f.dataType).alias(f.name))
        elif f.name == "app_version":
            out.append(F.lit(APP_VERSION).alias(f.name))
        else:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
    return df.select(*out)


def run_metadata_table(runs: DataFrame) -> DataFrame:
    return fixed_table(runs, RUN_METADATA)


def dataset_profiles_table(profiles: DataFrame) -> DataFrame:
    renamed = profiles.withColumnRenamed("total_missing", "missing_values")
    return fixed_table(renamed, DATASET_PROFILES)


def training_metrics_table(metrics: DataFrame) -> DataFrame:
    return fixed_table(metrics, TRAINING_METRICS)
