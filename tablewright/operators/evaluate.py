"""Evaluation tables over (y_true, y_pred[, score]).

Curves and areas first count rows per distinct score, then take running totals
over score ranges, so no task sorts the whole test set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.running import positions, running_totals
from ..session import stage

EPSILON = 2.220446049250313e-16  # double rounding unit, the floor for relative errors


def _regression_label(r2: Column) -> Column:
    return (
        F.when(r2 < 0.30, "Weak predictive power")
        .when(r2 < 0.70, "Moderate predictive power")
        .when(r2.isNotNull(), "Strong predictive power")
    )


def _classification_label(accuracy: Column) -> Column:
    return (
        F.when(accuracy < 0.60, "Weak performance")
        .when(accuracy < 0.80, "Moderate performance")
        .when(accuracy.isNotNull(), "Strong performance")
    )


def regression_metrics(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """R², MAE, RMSE, MAPE and a label, per group of ``by``."""
    y, p = F.col("y_true").cast("double"), F.col("y_pred").cast("double")
    sums = scored.groupBy(*by).agg(
        F.count(y).alias("n"),
        F.var_pop(y).alias("variance"),
        F.avg((y - p) * (y - p)).alias("mse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.avg(F.abs(y - p) / F.greatest(F.abs(y), F.lit(EPSILON))).alias("mape"),
    )
    # A constant target leaves R² without a scale: 1 for a perfect fit, else 0.
    r2 = F.when(F.col("variance") > 0, 1 - F.try_divide("mse", "variance")).when(
        F.col("n") > 0, F.when(F.col("mse") == 0, 1.0).otherwise(0.0)
    )
    return sums.select(*by, r2.alias("r2"), "mae", F.sqrt("mse").alias("rmse"), "mape").withColumn(
        "interpretation", _regression_label(F.col("r2"))
    )


def class_counts(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: support, predicted and hit counts; every row is counted on both sides of one shuffle."""
    cells = scored.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    sides = cells.select(
        *by,
        F.inline(
            F.array(
                F.struct(
                    F.col("y_true").alias("class"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                    F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("y_pred").alias("class"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                    F.lit(0).cast("long").alias("hits"),
                ),
            )
        ),
    )
    return sides.groupBy(*by, "class").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hits").alias("hits")
    )


def classification_metrics(scored: DataFrame, by: Sequence[str] = (), average: str = "auto") -> DataFrame:
    """Accuracy, precision, recall, F1 and a label.

    Two true classes are averaged as binary with the larger label positive
    (``average="auto"``), more are weighted by support. An undefined ratio is 0.
    """
    zero = F.lit(0.0)
    ratios = class_counts(scored, by).select(
        *by, "class", "support", "hits",
        F.coalesce(F.try_divide("hits", "predicted"), zero).alias("p"),
        F.coalesce(F.try_divide("hits", "support"), zero).alias("r"),
        F.coalesce(F.try_divide(F.col("hits") * 2, F.col("support") + F.col("predicted")), zero).alias("f"),
    )
    weight = F.col("support")
    total = F.sum("support")

    def positive(name: str) -> Column:
        return F.max_by(name, F.when(F.col("support") > 0, F.col("class")))

    out = ratios.groupBy(*by).agg(
        F.try_divide(F.sum("hits"), total).alias("accuracy"),
        F.count_if(F.col("support") > 0).alias("classes"),
        *[F.try_divide(F.sum(F.col(c) * weight), total).alias(f"w{c}") for c in "prf"],
        *[positive(c).alias(f"b{c}") for c in "prf"],
    )
    binary = F.lit(True) if average == "binary" else F.col("classes") == 2 if average == "auto" else F.lit(False)
    names = {"p": "precision", "r": "recall", "f": "f1"}
    return out.select(
        *by, "accuracy", *[F.when(binary, F.col(f"b{c}")).otherwise(F.col(f"w{c}")).alias(n) for c, n in names.items()]
    ).withColumn("interpretation", _classification_label(F.col("accuracy")))


def _score_counts(scored: DataFrame, by: Sequence[str], score: str, positive: Column) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.where(F.col(score).isNotNull()).groupBy(*by, (F.col(score).cast("double") + 0.0).alias("score")).agg(
        F.count_if(positive).alias("pos"), F.count_if(~positive).alias("neg")
    )


def area_under_roc(scored: DataFrame, positive: Column, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """Probability that a positive outranks a negative, ties counting half; null with one class only."""
    counts = _score_counts(scored, by, score, positive)
    ranked = running_totals(counts, "score", {"neg": "neg_upto"}, groups=by)
    wins = F.sum(F.col("pos").cast("double") * (F.col("neg_upto") - F.col("neg") / 2))
    return ranked.groupBy(*by).agg(
        wins.alias("wins"), F.sum("pos").cast("double").alias("p"), F.sum("neg").cast("double").alias("n")
    ).select(*by, F.try_divide("wins", F.col("p") * F.col("n")).alias("roc_auc"), "p", "n")


def roc_auc(scored: DataFrame, positive_label) -> DataFrame:
    return area_under_roc(scored, F.col("y_true") == F.lit(positive_label)).select("roc_auc")


def roc_auc_ovr(scored: DataFrame, class_scores: dict[str, str]) -> DataFrame:
    """One-against-rest areas weighted by support; ``class_scores`` maps label to score column."""
    entries = [F.struct(F.lit(c).alias("class"), F.col(s).cast("double").alias("score")) for c, s in class_scores.items()]
    long = scored.select(F.col("y_true").alias("y"), F.inline(F.array(*entries)))
    areas = area_under_roc(long, F.col("y") == F.col("class"), by=["class"])
    return areas.agg(F.try_divide(F.sum(F.col("roc_auc") * F.col("p")), F.sum("p")).alias("roc_auc"))


def confusion_matrix(scored: DataFrame) -> DataFrame:
    """Count for every (actual, predicted) pair of classes, zero included.

    Classes are numbered in a table of their own and the grid is a range of numbers, so no task or row holds all of
    them. Rows without an actual or a predicted class are in no cell.
    """
    cells = scored.groupBy(F.col("y_true").cast("string").alias("actual"), F.col("y_pred").cast("string").alias("predicted")).agg(
        F.count(F.lit(1)).alias("n")
    )
    cells = stage(cells, "confusion-cells")
    seen = cells.select("actual").union(cells.select("predicted")).where("actual is not null").distinct()
    classes = stage(positions(seen, "actual", "number"), "confusion-classes")
    n = classes.count()
    if not n:
        return cells.select("actual", "predicted", F.col("n").alias("count")).limit(0)
    grid = scored.sparkSession.range(n * n).select(F.expr(f"id div {n}").alias("i"), (F.col("id") % n).alias("j"))
    rows, columns = (classes.select(F.col("actual").alias(name), F.col("number").alias(k)) for name, k in (("actual", "i"), ("predicted", "j")))
    named = grid.join(rows, "i").join(columns, "j")
    return named.join(cells, ["actual", "predicted"], "left").select("actual", "predicted", F.coalesce("n", F.lit(0)).alias("count"))


def _curve_totals(scored: DataFrame, positive_label) -> tuple[DataFrame, int, int]:
    positive = F.col("y_true") == F.lit(positive_label)
    known = scored.where(F.col("score").isNotNull())
    row = known.agg(F.count_if(positive), F.count_if(~positive)).first()
    totals = running_totals(_score_counts(scored, [], "score", positive), "score", {"pos": "tp", "neg": "fp"}, descending=True)
    return totals, row[0], row[1]


def roc_curve(scored: DataFrame, positive_label) -> DataFrame:
    """(threshold, fpr, tpr) per distinct score, with the origin (null threshold)."""
    totals, p, n = _curve_totals(scored, positive_label)
    points = totals.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp").cast("double"), F.lit(float(n))).alias("fpr"),
        F.try_divide(F.col("tp").cast("double"), F.lit(float(p))).alias("tpr"),
    )
    origin = scored.sparkSession.createDataFrame([(None, 0.0, 0.0)], "threshold double, fpr double, tpr double")
    return points.unionByName(origin)


def roc_curve_area(scored: DataFrame, positive_label) -> DataFrame:
    """Area under the trapezoids of the curve, which is the rank form of the area."""
    return roc_auc(scored, positive_label).withColumnRenamed("roc_auc", "area")


def pr_curve(scored: DataFrame, positive_label) -> DataFrame:
    """(threshold, precision, recall) per distinct score, with the closing point (1, 0)."""
    totals, p, _ = _curve_totals(scored, positive_label)
    points = totals.select(
        F.col("score").alias("threshold"),
        F.try_divide(F.col("tp").cast("double"), (F.col("tp") + F.col("fp")).cast("double")).alias("precision"),
        F.try_divide(F.col("tp").cast("double"), F.lit(float(p))).alias("recall"),
    )
    end = scored.sparkSession.createDataFrame([(None, 1.0, 0.0)], "threshold double, precision double, recall double")
    return points.unionByName(end)


def pr_curve_area(scored: DataFrame, positive_label) -> DataFrame:
    """Area under precision against recall by trapezoids.

    The point before each score follows from its own totals, except for the
    precision before the first score, which is the closing point's 1.
    """
    totals, p, _ = _curve_totals(scored, positive_label)
    before_tp, before_all = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    here = F.col("tp") / (F.col("tp") + F.col("fp"))
    before = F.when(before_all > 0, F.try_divide(before_tp, before_all)).otherwise(1.0)
    return totals.agg(F.sum(F.try_divide(F.col("pos"), F.lit(float(p))) * (here + before) / 2).alias("area"))


def predicted_vs_actual(scored: DataFrame) -> DataFrame:
    """Points with the ends of the identity line on every row."""
    low, high = scored.agg(
        F.least(F.min("y_true"), F.min("y_pred")), F.greatest(F.max("y_true"), F.max("y_pred"))
    ).first()
    return scored.select("y_true", "y_pred", F.lit(low).alias("line_min"), F.lit(high).alias("line_max"))


def residuals(scored: DataFrame) -> DataFrame:
    return scored.select("y_pred", (F.col("y_true") - F.col("y_pred")).alias("residual"))


def top_feature_importance(importance: DataFrame, count: int = 15) -> DataFrame:
    """The largest importances, in ascending order for display."""
    return importance.orderBy(F.desc("importance"), "feature").limit(count).orderBy("importance", F.desc("feature"))


def select_best_model(metrics: DataFrame, task: str) -> DataFrame:
    """Highest R² (regression) or F1; the earlier model wins a tie; no row when nothing trained."""
    score = "r2" if task == "regression" else "f1"
    known = metrics.where(F.col(score).isNotNull() & ~F.isnan(score))
    best = F.max_by("model", F.struct(F.col(score), -F.col("ordinal")))
    out = known.agg(best.alias("best_model"), F.max(score).alias("best_score")).where("best_model is not null")
    if task == "regression":
        return out.withColumn("warning", negative_r2_text(F.col("best_score")))
    return out.withColumn("warning", F.lit(None).cast("string"))


def negative_r2_text(best: Column) -> Column:
    return F.when(best < 0, "All models have negative R2; check data quality")


def negative_r2_warning(metrics: DataFrame) -> DataFrame:
    """One row with a warning when even the best R² is below 0."""
    return metrics.agg(F.max("r2").alias("best_r2")).select("best_r2", negative_r2_text(F.col("best_r2")).alias("warning"))


def select_best_rmse_f1(metrics: DataFrame, task: str) -> DataFrame:
    """Lowest RMSE (regression) or highest weighted F1; the earlier model wins a tie."""
    if task == "regression":
        pick, value = F.min_by("model", F.struct("rmse", "ordinal")), F.min("rmse")
        known = metrics.where("rmse is not null")
    else:
        pick, value = F.max_by("model", F.struct(F.col("f1"), -F.col("ordinal"))), F.max("f1")
        known = metrics.where("f1 is not null")
    return known.agg(pick.alias("best_model"), value.alias("best_score")).where("best_model is not null")


REGRESSION_COLUMNS = ["r2", "mae", "rmse", "mape"]
CLASSIFICATION_COLUMNS = ["accuracy", "precision", "recall", "f1", "roc_auc"]


def scored_metrics(scored: DataFrame, task: str) -> DataFrame:
    """Unrounded metrics per model from the stacked test rows (model, y_true, y_pred[, score])."""
    if task == "regression":
        return regression_metrics(scored, ["model"])
    return classification_metrics(scored, ["model"])


def metric_text(value: Column) -> Column:
    """Four decimals, or scientific notation for small non-zero values."""
    return (
        F.when(value == 0, "0.0000")
        .when(F.abs(value) < 0.001, F.format_string("%.4e", value))
        .otherwise(F.format_string("%.4f", value))
    )


def leakage_warning(metrics: DataFrame) -> DataFrame:
    """Flags a fit too good to trust."""
    suspicious = F.coalesce(F.col("r2") >= 0.99, F.lit(False)) | F.coalesce(F.col("rmse") < 1e-5, F.lit(False))
    text = "Near-perfect performance detected. Verify that target leakage is not present."
    return metrics.withColumn("warning", F.when(suspicious, text))


def metrics_table(metrics: DataFrame, task: str, as_text: bool = False) -> DataFrame:
    """Display form: task columns rounded to four decimals, or formatted as text."""
    names = [c for c in (REGRESSION_COLUMNS if task == "regression" else CLASSIFICATION_COLUMNS) if c in metrics.columns]
    names += [c for c in ("training_seconds",) if c in metrics.columns]
    show = metric_text if as_text else (lambda c: F.round(c, 4))
    return metrics.select("model", *[show(F.col(c)).alias(c) for c in names])


def best_model_summary(metrics: DataFrame, task: str) -> DataFrame:
    """The winner with its two headline metrics, null when absent."""
    names = ["r2", "rmse"] if task == "regression" else ["f1", "roc_auc"]
    best = select_best_model(metrics, task).select("best_model")
    values = [F.round(c, 4).alias(c) if c in metrics.columns else F.lit(None).cast("double").alias(c) for c in names]
    return best.join(metrics.select(F.col("model").alias("best_model"), *values), "best_model")
