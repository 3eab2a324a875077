"""Fitted models with their feature schema."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import SparkSession, types as T

from ..plans.training import FinalModel, KeptNeighbours
from ..session import stage


def _plain(name: str) -> str:
    if not name or not isinstance(name, str):
        raise ValueError("model name must be a non-empty string")
    if "/" in name or "\\" in name or name in (".", ".."):
        raise ValueError("model name must not contain path parts")
    return name


def model_save(final: FinalModel, name: str, folder: str, spark: SparkSession) -> str:
    """Write pipeline and schema under ``folder/name``; an existing model is replaced.

    The neighbour model is its preprocessing, its training rows beside it, and its classes in the schema.
    """
    path = f"{folder.rstrip('/')}/{_plain(name)}"
    kept = isinstance(final.model, KeptNeighbours)
    if kept:
        stage(final.model.rows, "rows").write.mode("overwrite").parquet(f"{path}/rows")  # they may come from this very place
    (final.model.prepare if kept else final.model).write().overwrite().save(f"{path}/model")
    document = {
        "model": final.name, "target_column": final.target, "problem_type": final.task, "features": json.loads(final.schema.json()),
        "feature_names": final.names, "classes": [str(v) for v in final.model.labels] if kept else None,
    }
    spark.createDataFrame([(json.dumps(document),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/feature_schema")
    return path


def _exists(spark: SparkSession, path: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        spark.read.text(path).schema
        return True
    except AnalysisException:
        return False


def model_load(spark: SparkSession, folder: str, name: str = "best_model") -> FinalModel:
    path = f"{folder.rstrip('/')}/{_plain(name)}"
    if not _exists(spark, f"{path}/model/metadata"):
        raise FileNotFoundError(f"model not found: {path}/model")
    if not _exists(spark, f"{path}/feature_schema"):
        raise FileNotFoundError(f"feature schema not found: {path}/feature_schema; train again to write it")
    document = json.loads(spark.read.text(f"{path}/feature_schema").first()[0])
    model = PipelineModel.load(f"{path}/model")
    if document.get("classes") is not None:
        model = KeptNeighbours(model, spark.read.parquet(f"{path}/rows"), document["classes"])
    return FinalModel(
        document["model"], document["problem_type"], document["target_column"], T.StructType.fromJson(document["features"]),
        model, document["feature_names"],
    )
