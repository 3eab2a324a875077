"""Reports as one JSON document per dataset or run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.tables import join_by

# Fixed value: the version that reports carry.
REPORT_VERSION = "1.0"


def _generated() -> Column:
    return F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")


def _collected(df: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Rows of a per-column or per-model table as one array; their number follows the schema, not the data."""
    fields = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(name))


def dataset_report(summary: DataFrame, columns: DataFrame, cleaning: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Profile and cleaning report as JSON, one row per dataset named by ``keys``."""
    keys = keys or []
    cleaned = cleaning.select(*keys, F.struct(*[c for c in cleaning.columns if c not in keys]).alias("cleaning_summary"))
    totals = [c for c in summary.columns if c not in keys]
    joined = join_by(join_by(summary, _collected(columns, keys, "column_profile"), keys), cleaned, keys)
    body = F.struct(
        F.lit(REPORT_VERSION).alias("report_version"), _generated().alias("generated_at"),
        F.struct(*totals, "column_profile").alias("profile_summary"), "cleaning_summary",
    )
    return joined.select(*keys, F.to_json(body).alias("report"))


def model_report(problem_type: str, best_model_name: str, metrics: DataFrame, importance: DataFrame | None = None) -> DataFrame:
    """Metrics per model, the winner's metrics and its importances as one JSON row."""
    for name, value in (("problem_type", problem_type), ("best_model_name", best_model_name)):
        if not value or not isinstance(value, str):
            raise ValueError(f"{name} must be a non-empty string")
    names = [c for c in metrics.columns if c not in ("model", "ordinal")]
    pairs = metrics.agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("model", F.to_json(F.struct(*names)).alias("m"))))).alias("all")
    )
    fields = [
        F.lit(REPORT_VERSION).alias("report_version"), _generated().alias("generated_at"), F.lit(problem_type).alias("problem_type"),
        F.lit(best_model_name).alias("best_model_name"),
    ]
    typed = metrics.select(*names).schema
    schema = typed.simpleString()
    row = pairs.select(F.transform_values("all", lambda _, m: F.from_json(m, schema)).alias("metrics"))
    if importance is not None:
        listed = importance.agg(
            F.transform(
                F.sort_array(F.collect_list(F.struct((-F.col("importance")).alias("order"), "feature"))),
                lambda x: F.struct(x["feature"].alias("feature"), (-x["order"]).alias("importance")),
            ).alias("feature_importance")
        )
        row = join_by(row, listed, [])
        fields.append(F.col("feature_importance"))
    fields += [F.col("metrics"), F.try_element_at("metrics", F.lit(best_model_name)).alias("best_model_metrics")]
    return row.select(F.to_json(F.struct(*fields)).alias("report"))


def save_report(report: DataFrame, name: str, folder: str) -> str:
    """Write report rows as JSON text under a plain name."""
    if not name or "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError("report name must be a plain, non-empty name")
    path = f"{folder.rstrip('/')}/{name}"
    report.select("report").write.mode("overwrite").text(path)
    return path
