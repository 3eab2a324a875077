"""Preprocessing and the candidate estimators with the parameters of the libraries being matched."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression, NaiveBayes
from pyspark.ml.feature import OneHotEncoder, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, functions as F

from ..functions.columns import DATETIME, as_double, columns_of_kind, numeric_columns
from . import clean
from .boosting import BoostedTrees
from .features import INFREQUENT, fit_categories
from .transformers import FourierMachines, RandomFourier
from .trees import Forest

SEED = 42
MAX_DEPTH = 30  # trees elsewhere have no limit
TREES = 100
ROUNDS = 100
PARTITION_BYTES = 32 << 20  # of a solver's rows in one task


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _name(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


@dataclass
class Preprocessor:
    """Fitted preprocessing: a pipeline up to the ``features`` vector, and the vector's names."""

    model: PipelineModel
    names: list[str]
    columns: list[str]


def build_preprocessor(df: DataFrame, columns: Sequence[str] | None = None) -> Preprocessor:
    """Numbers: mean for missing, then zero mean and unit population variance.
    Others: most frequent for missing, then indicators, at most 50 per column; unknown is all zero.
    """
    used = [c for c in (columns if columns is not None else df.columns) if c not in columns_of_kind(df, DATETIME)]
    if not used:
        raise ValueError("no feature columns")
    numbers = [c for c in used if c in numeric_columns(df)]
    others = [c for c in used if c not in numbers]
    parts, assembled, names = [], [], []
    if numbers:
        stats = df.agg(
            F.count(F.lit(1)).alias("rows"),
            *[
                F.struct(F.count(as_double(df, c)), F.avg(as_double(df, c)), F.var_pop(as_double(df, c))).alias(f"s{i}")
                for i, c in enumerate(numbers)
            ],
        ).first()
        for i, c in enumerate(numbers):
            n, mean, variance = stats[f"s{i}"]
            # The mean replaces missing values before the variance is taken.
            deviation = math.sqrt((variance or 0.0) * n / stats["rows"]) if n else 0.0
            x = f"CAST({_name(c)} AS DOUBLE)"
            parts.append(
                f"coalesce((CASE WHEN NOT isnan({x}) THEN {x} END - {_number(mean or 0.0)}) / {_number(deviation or 1.0)}, 0D) AS __num{i}"
            )
            assembled.append(f"__num{i}")
            names.append(c)
    indexers = []
    if others:
        modes = clean.fit_modes(df, others)
        kept = fit_categories(df, others)
        for i, c in enumerate(others):
            labels, pool = kept[c]
            text = f"CAST({_name(c)} AS STRING)"
            if pool:
                inside = ", ".join(_text(v) for v in labels)
                text = f"CASE WHEN {text} IN ({inside}) THEN {text} WHEN {text} IS NOT NULL THEN {_text(INFREQUENT)} END"
                mode = modes[c] if modes[c] in labels else INFREQUENT
                labels = [*labels, INFREQUENT]
            else:
                mode = modes[c]
            parts.append(f"coalesce({text}, {_text(mode)}) AS __cat{i}" if mode is not None else f"{text} AS __cat{i}")
            indexers.append((f"__cat{i}", labels or [INFREQUENT]))
            assembled.append(f"__hot{i}")
            names += [f"{c}_{v}" for v in (labels or [INFREQUENT])]
    stages = [SQLTransformer(statement=f"SELECT *, {', '.join(parts)} FROM __THIS__")]
    if indexers:
        # Unknown values take one more slot, and that last slot is the one the encoder drops.
        index = [
            StringIndexerModel.from_labels(labels, c, c.replace("cat", "idx"), handleInvalid="keep") for c, labels in indexers
        ]
        hot = OneHotEncoder(
            inputCols=[c.replace("cat", "idx") for c, _ in indexers], outputCols=[c.replace("cat", "hot") for c, _ in indexers],
            dropLast=True,
        )
        stages += [*index, hot]
    stages.append(VectorAssembler(inputCols=assembled, outputCol="features"))
    return Preprocessor(Pipeline(stages=stages).fit(df), names, used)


@dataclass
class FitContext:
    """Facts of the prepared training rows (features, label) that parameters depend on."""

    train: DataFrame
    task: str
    classes: int = 0
    seed: int = SEED
    trees: int = TREES
    rounds: int = ROUNDS
    depth: int = MAX_DEPTH
    components: int = 100
    draws: int = 32
    _facts: dict = field(default_factory=dict)

    def facts(self) -> dict:
        if not self._facts:
            summary = Summarizer.metrics("mean", "variance", "min", "max", "count").summary(F.col("features"))
            row = self.train.agg(summary.alias("f"), F.stddev_pop("label").alias("sigma")).first()
            f = row["f"]
            self._facts.update(
                rows=f["count"], sigma=row["sigma"] or 0.0, mean=f["mean"].toArray(), variance=f["variance"].toArray(),
                low=f["min"].toArray(), high=f["max"].toArray(),
            )
        return self._facts


def _linear(c: FitContext):
    return [LinearRegression(regParam=0.0)]


def _ridge(c: FitContext, alpha: float = 1.0):
    f = c.facts()
    return [LinearRegression(elasticNetParam=0.0, regParam=alpha * f["sigma"] / f["rows"], standardization=False)]


def _lasso(c: FitContext, alpha: float = 1.0):
    return [LinearRegression(elasticNetParam=1.0, regParam=alpha, standardization=False, tol=1e-10, maxIter=1000)]


def _elastic_net(c: FitContext, alpha: float = 1.0, share: float = 0.5):
    """The mix is rescaled because the squared penalty is taken on a target scaled to unit deviation."""
    first, second = alpha * share, alpha * (1 - share) * c.facts()["sigma"]
    return [
        LinearRegression(
            elasticNetParam=first / (first + second), regParam=first + second, standardization=False, tol=1e-10, maxIter=1000
        )
    ]


def _tree_regressor(c: FitContext):
    return [Forest(depth=c.depth, randomSeed=c.seed)]


def _forest_regressor(c: FitContext):
    return [Forest(trees=c.trees, bootstrap=True, depth=c.depth, randomSeed=c.seed)]


def _extra_regressor(c: FitContext):
    return [Forest(trees=c.trees, random=True, depth=c.depth, randomSeed=c.seed)]


def _boost_regressor(c: FitContext):
    return [BoostedTrees(rounds=c.rounds, step=0.1, depth=3, l2=0.0)]


def _second_order(**settings):
    return lambda c: [BoostedTrees(rounds=c.rounds, **settings)]


def _logistic(c: FitContext):
    return [
        LogisticRegression(maxIter=1000, regParam=1.0 / c.facts()["rows"], elasticNetParam=0.0, standardization=False, tol=1e-9)
    ]


def _tree_classifier(c: FitContext):
    return [Forest(classes=c.classes, depth=c.depth, randomSeed=c.seed)]


def _root(c: FitContext) -> int:
    """Features drawn for a node: the root of their number."""
    return max(1, math.isqrt(len(c.facts()["low"])))


def _forest_classifier(c: FitContext):
    return [Forest(classes=c.classes, trees=c.trees, subset=_root(c), bootstrap=True, depth=c.depth, randomSeed=c.seed)]


def _extra_classifier(c: FitContext):
    return [Forest(classes=c.classes, trees=c.trees, subset=_root(c), random=True, depth=c.depth, randomSeed=c.seed)]


def _boost_classifier(c: FitContext):
    return [BoostedTrees(rounds=c.rounds, step=0.1, depth=3, l2=0.0, classes=c.classes)]


def _svm(c: FitContext):
    """Gaussian kernel through random Fourier features; probabilities by logistic calibration of the margins."""
    import numpy as np

    f = c.facts()
    spread = float(np.mean(f["variance"] + f["mean"] ** 2) - np.mean(f["mean"]) ** 2)
    size = len(f["mean"])
    fourier = RandomFourier(
        inputCol="features", outputCol="waves", gamma=1.0 / (size * (spread or 1.0)), components=c.components, size=size, randomSeed=c.seed
    )
    machines = FourierMachines(fourier, c.classes, 1.0 / f["rows"], f["rows"])
    calibration = LogisticRegression(
        featuresCol="rawPrediction", probabilityCol="probability", predictionCol="calibrated", rawPredictionCol="calibrated_raw"
    )
    return [machines, calibration]


def _gaussian_bayes(c: FitContext):
    return [NaiveBayes(modelType="gaussian")]


REGRESSION = {
    "Linear Regression": _linear,
    "Ridge": _ridge,
    "Lasso": _lasso,
    "ElasticNet": _elastic_net,
    "Decision Tree": _tree_regressor,
    "Random Forest": _forest_regressor,
    "Extra Trees": _extra_regressor,
    "Gradient Boosting": _boost_regressor,
    "XGBoost": _second_order(step=0.3, depth=6, l2=1.0),
    "LightGBM": _second_order(step=0.1, depth=64, leaves=31, least=20, l2=0.0),
}

NEIGHBOURS = "KNN"

CLASSIFICATION = {
    "Logistic Regression": _logistic,
    "Decision Tree": _tree_classifier,
    "Random Forest": _forest_classifier,
    "Extra Trees": _extra_classifier,
    "Gradient Boosting": _boost_classifier,
    NEIGHBOURS: None,  # no model to fit: the training rows are joined when scoring
    "SVM": _svm,
    "GaussianNB": _gaussian_bayes,
}


def registry(task: str) -> dict:
    if task == "regression":
        return REGRESSION
    if task == "classification":
        return CLASSIFICATION
    raise ValueError(f"unsupported problem type: {task}")


def partitions_for(rows: int, values: int) -> int:
    """Partitions whose rows, as vectors of ``values`` numbers, take about ``PARTITION_BYTES``.

    The written rows are read in parts of equal compressed size, and a few distinct numbers compress to nearly nothing: what a task
    of a solver then holds and reads again in every step would grow with the table.
    """
    return max(1, -(-rows * 8 * (values + 2) // PARTITION_BYTES))


def fit(name: str, context: FitContext) -> PipelineModel:
    """Fit one candidate on prepared rows."""
    make = registry(context.task).get(name)
    if make is None:
        raise ValueError(f"unknown model {name!r}")
    stages = make(context)
    if not isinstance(stages[0], (Forest, BoostedTrees)):  # those deal their rows themselves
        parts = partitions_for(context.facts()["rows"], len(context.facts()["low"]))
        if parts > 1:
            return Pipeline(stages=stages).fit(context.train.repartition(parts))
    return Pipeline(stages=stages).fit(context.train)


def class_scores(scored: DataFrame):
    """Score per class as an array column: probabilities, else margins; null without either."""
    for name in ("probability", "rawPrediction"):
        if name in scored.columns:
            return vector_to_array(name)
    return F.lit(None).cast("array<double>")


def feature_importance(model: PipelineModel, names: Sequence[str], df: DataFrame) -> DataFrame | None:
    """(feature, importance), largest first; None for a model that has neither importances nor coefficients."""
    import numpy as np

    values = None
    for stage in model.stages:
        if hasattr(stage, "featureImportances"):
            values = stage.featureImportances.toArray()
        elif hasattr(stage, "models") and all(hasattr(m, "featureImportances") for m in stage.models):
            values = np.mean([m.featureImportances.toArray() for m in stage.models], axis=0)
        elif hasattr(stage, "coefficientMatrix"):
            values = np.abs(stage.coefficientMatrix.toArray()).mean(axis=0)
        elif hasattr(stage, "coefficients"):
            values = np.abs(stage.coefficients.toArray())
    if values is None or any(isinstance(s, RandomFourier) for s in model.stages):
        return None
    rows = [(n, float(v)) for n, v in zip(names, values)]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double").orderBy(F.desc("importance"), "feature")
