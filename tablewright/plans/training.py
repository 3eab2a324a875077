"""Training workflow: split, prepare, fit every candidate, compare, refit the best."""

from __future__ import annotations

import time
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.feature import IndexToString
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F, types as T

from ..functions.columns import quoted
from ..functions.tables import map_in_threads, union_all
from ..operators import estimators as E, evaluate, features
from ..operators.clean import drop_missing_target
from ..operators.neighbors import nearest_neighbours
from ..session import stage

MINIMUM_ROWS = 10
K = 5


@dataclass
class TrainingResult:
    task: str
    target: str
    schema: T.StructType
    labels: list | None
    candidates: DataFrame  # model, ordinal, status, error, training_seconds
    scored: DataFrame  # model, y_true, y_pred[, scores]
    metrics: DataFrame  # one row per trained model
    fitted: dict = field(default_factory=dict)
    best_model: str | None = None


@dataclass
class NeighbourModel:
    """Prepared training rows; scoring joins them with the rows to score."""

    train: DataFrame
    classes: int

    def predict(self, rows: DataFrame) -> DataFrame:
        """Adds prediction and the share of votes per class to rows with (row_id, features)."""
        asked = rows.select(F.col("row_id").alias("id"), vector_to_array("features").alias("vector"))
        known = self.train.select(F.col("row_id").alias("id"), vector_to_array("features").alias("vector"), "label")
        near = nearest_neighbours(known, asked, K)
        votes = near.groupBy("test_id").agg(
            F.array(*[F.count_if(F.col("label") == i) / F.count(F.lit(1)) for i in range(self.classes)]).alias("votes")
        )
        best = F.array_position("votes", F.array_max("votes")).cast("double") - 1
        return rows.join(votes, F.col("row_id") == F.col("test_id")).drop("test_id").withColumn("prediction", best)


def class_labels(df: DataFrame, target: str) -> list:
    """Classes in order; the labels of every row, so that none is unknown at test time."""
    return sorted(r[0] for r in df.select(quoted(target)).where(quoted(target).isNotNull()).distinct().collect())


def _labelled(df: DataFrame, target: str, labels: list | None) -> DataFrame:
    """Adds ``label``: the number, or the place of the class among the classes."""
    if labels is None:
        return df.withColumn("label", quoted(target).cast("double"))
    table = df.sparkSession.createDataFrame(
        [(v, float(i)) for i, v in enumerate(labels)], T.StructType([T.StructField("__class", df.schema[target].dataType), T.StructField("label", T.DoubleType())])
    )
    return df.join(table, quoted(target) == F.col("__class"), "left").drop("__class")


def _check(df: DataFrame, target: str, task: str) -> None:
    if target not in df.columns:
        raise ValueError(f"target column {target!r} not found")
    E.registry(task)
    rows = df.limit(MINIMUM_ROWS).count()
    if rows < MINIMUM_ROWS:
        raise ValueError(f"dataset too small for training: {rows} rows")


def split_rows(df: DataFrame, target: str, task: str, key: Sequence[str], test_size: float) -> DataFrame:
    if task == "classification":
        return features.stratified_split(df, key, target, test_size)
    return features.train_test_split(df, key, test_size)


def train_candidates(
    df: DataFrame, target: str, task: str, key: Sequence[str] | None = None, models: Sequence[str] | None = None,
    test_size: float = 0.2, seed: int = E.SEED, parallelism: int = 4, **sizes,
) -> TrainingResult:
    """Fit every candidate on the training side and score the test side.

    ``key`` names the columns that identify a row (all columns by default; equal
    rows then share a side) and are no features when given. A candidate that
    fails is reported, not raised. ``sizes`` sets trees, rounds, depth, ...
    """
    _check(df, target, task)
    names = list(models if models is not None else E.registry(task))
    unknown = [n for n in names if n not in E.registry(task)]
    if unknown:
        raise ValueError(f"unknown models: {', '.join(unknown)}")
    rows = drop_missing_target(df, target)
    columns = [c for c in features.select_features(rows, target).columns if c not in (key or [])]
    labels = class_labels(rows, target) if task == "classification" else None
    sides = stage(split_rows(rows, target, task, list(key or df.columns), test_size), "split")
    training = sides.where("split = 'train'")
    prepare = E.build_preprocessor(training.select(*[quoted(c) for c in columns]))
    prepared = stage(
        _labelled(prepare.model.transform(sides), target, labels).select(
            F.monotonically_increasing_id().alias("row_id"), "split", "features", "label"
        ),
        "prepared",
    )
    train, test = prepared.where("split = 'train'").drop("split"), prepared.where("split = 'test'").drop("split")
    context = E.FitContext(train, task, len(labels or []), seed, **sizes)
    context.facts()
    fitted, outcome = {}, {}

    def attempt(name: str) -> None:
        start = time.time()
        try:
            model = NeighbourModel(train, len(labels)) if name == E.NEIGHBOURS else E.fit(name, context)
            fitted[name] = model
            outcome[name] = ("trained", None, round(time.time() - start, 4))
        except Exception as error:  # noqa: BLE001 - the failure is part of the comparison
            outcome[name] = ("failed", str(error), round(time.time() - start, 4))

    map_in_threads(df, attempt, names, parallelism)
    candidates = df.sparkSession.createDataFrame(
        [(n, i, *outcome[n]) for i, n in enumerate(names)],
        "model string, ordinal int, status string, error string, training_seconds double",
    )
    if not fitted:
        raise RuntimeError("no model trained successfully: " + "; ".join(f"{n}: {outcome[n][1]}" for n in names))
    scored = union_all([_scored(fitted[n], test, n, labels) for n in names if n in fitted])
    if len(fitted) > 1 or task == "classification":
        scored = stage(scored, "scored")  # read once per metric, costly to score again
    metrics = candidate_metrics(scored, task, labels).join(candidates.select("model", "ordinal", "training_seconds"), "model")
    return TrainingResult(task, target, sides.select(*[quoted(c) for c in columns]).schema, labels, candidates, scored, metrics, fitted)


def _scored(model, test: DataFrame, name: str, labels: list | None) -> DataFrame:
    if isinstance(model, NeighbourModel):
        out, scores = model.predict(test), F.col("votes")
    else:
        out = model.transform(test)
        scores = E.class_scores(out)
    if labels is None:
        return out.select(F.lit(name).alias("model"), F.col("label").alias("y_true"), F.col("prediction").alias("y_pred"))
    return out.select(
        F.lit(name).alias("model"), F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"),
        scores.alias("scores"),
    )


def candidate_metrics(scored: DataFrame, task: str, labels: list | None) -> DataFrame:
    """Metrics per model; classes are compared by index, which follows label order."""
    base = evaluate.scored_metrics(scored, task)
    if task == "regression":
        return base
    entries = scored.where("scores is not null").select("model", "y_true", F.posexplode("scores").alias("class", "score"))
    if len(labels) == 2:
        entries = entries.where("class = 1")
    areas = evaluate.area_under_roc(entries, F.col("y_true") == F.col("class"), by=["model", "class"])
    auc = areas.groupBy("model").agg(F.try_divide(F.sum(F.col("roc_auc") * F.col("p")), F.sum("p")).alias("roc_auc"))
    return base.join(auc, "model", "left")


def decoded(scored: DataFrame, labels: list) -> DataFrame:
    """Class indices back to their labels."""
    names = F.array(*[F.lit(v) for v in labels])
    return scored.withColumns({c: F.get(names, F.col(c)) for c in ("y_true", "y_pred")})


@dataclass
class KeptNeighbours:
    """The neighbour model as a winner: preprocessing, all training rows, and the classes."""

    prepare: PipelineModel
    rows: DataFrame  # row_id, features, label
    labels: list

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds prediction and predicted_label, like a fitted pipeline."""
        asked = stage(self.prepare.transform(df).withColumn("row_id", F.monotonically_increasing_id()), "asked")
        found = NeighbourModel(self.rows, len(self.labels)).predict(asked)
        names = F.array(*[F.lit(str(v)) for v in self.labels])
        return found.withColumn("predicted_label", F.get(names, F.col("prediction").cast("int"))).drop("row_id")


@dataclass
class FinalModel:
    """The winner fitted on all rows: one step from feature columns to prediction."""

    name: str
    task: str
    target: str
    schema: T.StructType
    model: PipelineModel | KeptNeighbours
    names: list[str]

    def importance(self, df: DataFrame) -> DataFrame | None:
        return None if isinstance(self.model, KeptNeighbours) else E.feature_importance(self.model, self.names, df)


def retrain_best(
    df: DataFrame, target: str, task: str, name: str, key: Sequence[str] | None = None, seed: int = E.SEED, **sizes
) -> FinalModel:
    """Fit preprocessing and the named candidate on every row."""
    rows = drop_missing_target(df, target)
    columns = [c for c in features.select_features(rows, target).columns if c not in (key or [])]
    labels = class_labels(rows, target) if task == "classification" else None
    inputs = rows.select(*[quoted(c) for c in columns])
    prepare = E.build_preprocessor(inputs)
    prepared = _labelled(prepare.model.transform(rows), target, labels)
    if name == E.NEIGHBOURS and labels is not None:
        known = stage(prepared.select(F.monotonically_increasing_id().alias("row_id"), "features", "label"), "neighbours")
        return FinalModel(name, task, target, inputs.schema, KeptNeighbours(prepare.model, known, labels), prepare.names)
    prepared = stage(prepared.select("features", "label"), "prepared")
    fitted = E.fit(name, E.FitContext(prepared, task, len(labels or []), seed, **sizes))
    stages = [*prepare.model.stages, *fitted.stages]
    if labels is not None:
        stages.append(IndexToString(inputCol="prediction", outputCol="predicted_label", labels=[str(v) for v in labels]))
    return FinalModel(name, task, target, inputs.schema, PipelineModel(stages=stages), prepare.names)


def train_and_select(df: DataFrame, target: str, task: str, key: Sequence[str] | None = None, **options) -> tuple[TrainingResult, FinalModel]:
    """Compare all candidates and refit the best."""
    result = train_candidates(df, target, task, key, **options)
    result.best_model = evaluate.select_best_model(result.metrics, task).first()["best_model"]
    sizes = {k: v for k, v in options.items() if k in ("seed", "trees", "rounds", "depth", "components", "draws")}
    return result, retrain_best(df, target, task, result.best_model, key, **sizes)
