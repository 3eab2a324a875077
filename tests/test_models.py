"""Evaluation, models, prediction and storage against closed forms and brute force."""

import json
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import estimators as E, evaluate as V, neighbors, predict
from tablewright.plans import training as TR
from tablewright.session import scratch_path
from tablewright.sources import csv, models, reports, runs, warehouse


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.RandomState(0)
    x = rng.normal(size=(300, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = 3 * x[:, 0] - 2 * x[:, 1] + 4 * x[:, 2] + rng.normal(size=300)
    rows = [(i, *map(float, x[i]), float(y[i])) for i in range(300)]
    return x, y, spark.createDataFrame(rows, "k int, a double, b double, c double, y double")


def coefficients(df, name):
    final = TR.retrain_best(df, "y", "regression", name, key=["k"])
    return next(s for s in final.model.stages if hasattr(s, "coefficients")).coefficients.toArray()


def test_linear_family_matches_the_objective(regression):
    x, y, df = regression
    z = (x - x.mean(0)) / x.std(0)
    t, n = y - y.mean(), len(y)
    gram, cross = z.T @ z / n, z.T @ t / n
    assert coefficients(df, "Linear Regression") == pytest.approx(np.linalg.solve(gram, cross), abs=1e-6)
    assert coefficients(df, "Ridge") == pytest.approx(np.linalg.solve(gram + np.eye(3) / n, cross), abs=1e-6)
    for name, first, second in (("Lasso", 1.0, 0.0), ("ElasticNet", 0.5, 0.5)):
        w = np.zeros(3)
        for _ in range(2000):  # coordinate descent
            for j in range(3):
                rest = cross[j] - gram[j] @ w + gram[j, j] * w[j]
                w[j] = np.sign(rest) * max(abs(rest) - first, 0) / (gram[j, j] + second)
        assert coefficients(df, name) == pytest.approx(w, abs=1e-5)


def test_missing_and_unknown_features(spark):
    train = spark.createDataFrame([(1.0, "a"), (3.0, "b"), (None, "a"), (4.0, None)], "x double, s string")
    prepared = E.build_preprocessor(train)
    assert prepared.names == ["x", "s_a", "s_b"]
    rows = [r["features"].toArray() for r in prepared.model.transform(
        spark.createDataFrame([(None, "b"), (1.0, "never seen"), (1.0, None)], "x double, s string")).collect()]
    filled = np.array([1, 3, 8 / 3, 4])
    one = (1 - filled.mean()) / filled.std()
    assert rows[0] == pytest.approx([0, 0, 1]) and rows[1] == pytest.approx([one, 0, 0]) and rows[2] == pytest.approx([one, 1, 0])


@pytest.mark.parametrize("pivots,block", [(1, 1000), (7, 5), (40, 16)])
def test_neighbours_match_brute_force(spark, pivots, block):
    rng = np.random.RandomState(2)
    train = np.vstack([rng.normal(size=(120, 4)), np.tile([9.0, 9, 9, 9], (60, 1))])  # a crowded group of copies
    test = np.vstack([rng.normal(size=(25, 4)), [[9.0, 9, 9, 8]]])
    labels = rng.randint(0, 3, len(train))
    known = spark.createDataFrame([(i, v.tolist(), int(labels[i])) for i, v in enumerate(train)], "id int, vector array<double>, label int")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(test)], "id int, vector array<double>")
    got = {}
    for r in neighbors.nearest_neighbours(known, asked, 5, pivots, block).collect():
        got.setdefault(r["test_id"], []).append((r["place"], r["train_id"]))
    for i, q in enumerate(test):
        d = np.sqrt(((train - q) ** 2).sum(1))
        assert [t for _, t in sorted(got[i])] == sorted(range(len(train)), key=lambda j: (d[j], j))[:5]


def test_neighbours_of_many_copies_and_cells(spark, monkeypatch):
    """Cells follow the number of distinct rows, and copies are compared once."""
    rng = np.random.RandomState(3)
    points = np.column_stack([rng.randint(0, 25, 400), rng.normal(size=400).round(2)]).astype(float)
    rows = [(i, points[i % 400].tolist(), i % 3) for i in range(400 * 20)]
    df = spark.createDataFrame(rows, "id long, vector array<double>, label int")
    compared, blocks = [], neighbors._in_blocks
    monkeypatch.setattr(neighbors, "_in_blocks", lambda known, asked, *rest: compared.append(asked.count()) or blocks(known, asked, *rest))
    got = {}
    for r in neighbors.nearest_neighbours(df, df.where("id % 20 = 7"), 5, 4, 64).collect():
        got.setdefault(r["test_id"], []).append((r["place"], r["train_id"]))
    assert len(got) == 400 and compared[0] <= 400 and compared[1] <= 4 * compared[0]
    every = np.array([v for _, v, _ in rows])
    for i, found in got.items():
        d = np.sqrt(((every - every[i]) ** 2).sum(1))
        assert [t for _, t in sorted(found)] == list(np.lexsort((np.arange(len(d)), d))[:5])


def brute_auc(y, s):
    pairs = [(a > b) + 0.5 * (a == b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    return sum(pairs) / len(pairs)


def test_areas_match_brute_force(spark):
    rng = np.random.RandomState(4)
    y, s = rng.rand(200) < 0.3, np.where(rng.rand(200) < 0.4, 0.5, rng.rand(200).round(2))
    df = spark.createDataFrame([("p" if a else "n", float(b)) for a, b in zip(y, s)], "y_true string, score double")
    assert V.roc_auc(df, "p").first()[0] == pytest.approx(brute_auc(y, s))
    points = sorted((r["fpr"], r["tpr"]) for r in V.roc_curve(df, "p").collect())
    assert np.trapezoid([p[1] for p in points], [p[0] for p in points]) == pytest.approx(brute_auc(y, s))
    area = V.pr_curve_area(df, "p").first()[0]
    curve = V.pr_curve(df, "p").collect()
    ordered = sorted(curve, key=lambda r: math.inf if r["threshold"] is None else r["threshold"], reverse=True)
    assert np.trapezoid([r["precision"] for r in ordered], [r["recall"] for r in ordered]) == pytest.approx(area)


def test_area_needs_two_classes(spark):
    df = spark.createDataFrame([("p", 0.1), ("p", 0.9)], "y_true string, score double")
    assert V.roc_auc(df, "p").first()[0] is None


def test_metrics_at_the_edges(spark):
    constant = spark.createDataFrame([(2.0, 2.0), (2.0, 2.0)], "y_true double, y_pred double")
    assert V.regression_metrics(constant).first()["r2"] == 1.0
    one = spark.createDataFrame([("a", "b"), ("a", "a")], "y_true string, y_pred string")
    row = V.classification_metrics(one).first()
    assert row["accuracy"] == 0.5 and row["precision"] == 1.0 and row["interpretation"] == "Weak performance"


@pytest.mark.parametrize("r2,label", [(0.29, "Weak"), (0.30, "Moderate"), (0.69, "Moderate"), (0.70, "Strong")])
def test_strength_labels(spark, r2, label):
    df = spark.createDataFrame([(r2,)], "r2 double").select(V._regression_label(F.col("r2")))
    assert df.first()[0].startswith(label)


def test_selection_prefers_the_first_on_ties(spark):
    metrics = spark.createDataFrame([("b", 1, 0.5, 2.0), ("a", 0, 0.5, 2.0), ("c", 2, None, None)], "model string, ordinal int, r2 double, rmse double")
    assert V.select_best_model(metrics, "regression").first()["best_model"] == "a"
    assert V.select_best_rmse_f1(metrics, "regression").first()["best_model"] == "a"
    assert V.select_best_model(metrics.where("model = 'c'"), "regression").count() == 0


def test_training_workflow(spark):
    rng = np.random.RandomState(6)
    rows = [(i, float(a), "hi" if a + 0.3 * b > 0 else "lo", "u" if i % 2 else "v") for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    df = spark.createDataFrame(rows, "k int, x double, y string, s string")
    names = ["Logistic Regression", "Decision Tree", "Extra Trees", "KNN", "SVM", "GaussianNB"]
    result, final = TR.train_and_select(df, "y", "classification", key=["k"], models=names, trees=10, components=40)
    assert {r["status"] for r in result.candidates.collect()} == {"trained"}
    metrics = {r["model"]: r for r in result.metrics.collect()}
    assert len(metrics) == 6 and all(m["accuracy"] > 0.75 and m["roc_auc"] > 0.8 for m in metrics.values())
    assert result.best_model == max(names, key=lambda n: (metrics[n]["f1"], -names.index(n)))
    assert final.name == result.best_model
    folder = scratch_path(spark, "test-models")
    models.model_save(final, "best_model", folder, spark)
    loaded = models.model_load(spark, folder)
    out = predict.score(loaded.model, df, loaded.schema)
    assert out.columns == ["x", "s", "Prediction"] and {r[0] for r in out.select("Prediction").distinct().collect()} <= {"hi", "lo"}
    with pytest.raises(predict.PredictionValidationError, match="x"):
        predict.score(loaded.model, df.drop("x"), loaded.schema)


def test_a_failing_candidate_is_reported(spark, monkeypatch):
    df = spark.createDataFrame([(i, float(i % 7), float(i)) for i in range(40)], "k int, x double, y double")

    def broken(context):
        raise RuntimeError("no luck")

    monkeypatch.setitem(E.REGRESSION, "Ridge", broken)
    result = TR.train_candidates(df, "y", "regression", key=["k"], models=["Linear Regression", "Ridge"])
    assert {r["model"]: r["status"] for r in result.candidates.collect()} == {"Linear Regression": "trained", "Ridge": "failed"}
    assert [r["model"] for r in result.metrics.collect()] == ["Linear Regression"]


def test_training_input_checks(spark):
    df = spark.createDataFrame([(i, 1.0) for i in range(9)], "x int, y double")
    with pytest.raises(ValueError, match="too small"):
        TR.train_candidates(df, "y", "regression")
    with pytest.raises(ValueError, match="not found"):
        TR.train_candidates(df, "z", "regression")
    with pytest.raises(ValueError, match="unsupported"):
        TR.train_candidates(df, "y", "clustering")


def test_extra_trees_importance_adds_up(spark, regression):
    _, _, df = regression
    final = TR.retrain_best(df, "y", "regression", "Extra Trees", key=["k"], trees=10)
    rows = final.importance(df).collect()
    assert {r["feature"] for r in rows} == {"a", "b", "c"} and sum(r["importance"] for r in rows) == pytest.approx(1.0)
    assert rows[0]["feature"] == "b"


def test_model_names_and_absence(spark):
    with pytest.raises(ValueError):
        models.model_load(spark, "/tmp", "../x")
    with pytest.raises(FileNotFoundError):
        models.model_load(spark, scratch_path(spark, "nothing"))


def test_csv_types_and_quotes(spark):
    rows = [("1", "1.5", "True", "a,b", None), ("2", "x\"y", "false", "q\"r", None), (None, "3", "True", "line", None)]
    df = spark.createDataFrame(rows, "i string, m string, f string, t string, e string")
    path = scratch_path(spark, "test-csv")
    assert csv.csv_sink(df, path)
    back = csv.read_table(spark, path)
    assert dict(back.dtypes) == {"i": "bigint", "m": "string", "f": "boolean", "t": "string", "e": "double"}
    assert {r["t"] for r in back.collect()} == {"a,b", "q\"r", "line"}
    assert not csv.csv_sink(df.limit(0), scratch_path(spark, "test-csv"))


def test_run_documents(spark, tmp_path):
    for name, text in {"good": json.dumps({"run_id": "r1", "dataset_name": "d", "best_model": None}, indent=4), "broken": "{\"run_id\": ",
                       "nameless": json.dumps({"dataset_name": "e"}, indent=4)}.items():
        os.makedirs(tmp_path / name)
        (tmp_path / name / "metadata.json").write_text(text)
    found = runs.run_metadata_scan(spark, str(tmp_path))
    assert {r["run_id"] for r in found.collect()} == {"r1", "nameless"}
    shown = {r["run_id"]: r for r in runs.run_history(found).collect()}
    assert shown["r1"]["model"] == "Pending" and shown["r1"]["sync_metrics"] == "N/A"


def test_replacing_a_run_keeps_the_others(spark):
    path = scratch_path(spark, "test-runs")
    df = spark.createDataFrame([(1, "a")] * 3 + [(2, "b")], "v int, w string")
    status = warehouse.sync_artifacts(spark, {"data": df, "none": df.limit(0)}, path, "r1", dataset_name="d")
    assert {r["artifact"]: (r["status"], r["rows"]) for r in status.collect()} == {"data": ("Uploaded", 2), "none": ("Skipped", None)}
    warehouse.sync_artifacts(spark, {"data": df}, path, "r2", dataset_name="d")
    warehouse.sync_artifacts(spark, {"data": df.where("v = 1")}, path, "r1", dataset_name="d")
    counts = {r["run_id"]: r["count"] for r in spark.read.parquet(f"{path}/data").groupBy("run_id").count().collect()}
    assert counts == {"r1": 1, "r2": 2}


def test_required_run_id(spark):
    with pytest.raises(Exception, match="run_id is required"):
        warehouse.run_metadata_table(spark.createDataFrame([(None,)], "run_id string")).collect()


def test_reports(spark):
    metrics = spark.createDataFrame([("LinearRegression", 0.9)], "model string, r2 double")
    doc = json.loads(reports.model_report("regression", "LinearRegression", metrics).first()[0])
    assert doc["metrics"] == {"LinearRegression": {"r2": 0.9}} and doc["best_model_metrics"] == {"r2": 0.9}
    with pytest.raises(ValueError):
        reports.model_report("", "x", metrics)
    summary = spark.createDataFrame([(3, 2)], "rows long, columns int")
    columns = spark.createDataFrame([("a", 1), ("b", 2)], "column string, unique long")
    cleaning = spark.createDataFrame([(0, 3)], "duplicates_removed long, rows_after_cleaning long")
    doc = json.loads(reports.dataset_report(summary, columns, cleaning).first()[0])
    assert doc["profile_summary"]["rows"] == 3 and len(doc["profile_summary"]["column_profile"]) == 2
    with pytest.raises(ValueError):
        reports.save_report(reports.model_report("regression", "LinearRegression", metrics), "a/b", "/tmp")


def test_neighbours_can_be_kept(spark):
    rng = np.random.RandomState(6)
    rows = [(i, float(a), "hi" if a > 0 else "lo", "u" if i % 2 else "v") for i, a in enumerate(rng.normal(size=120))]
    df = spark.createDataFrame(rows, "k int, x double, y string, s string")
    final = TR.retrain_best(df, "y", "classification", "KNN", key=["k"])
    assert final.importance(df) is None
    folder = scratch_path(spark, "test-models")
    models.model_save(final, "best_model", folder, spark)
    loaded = models.model_load(spark, folder)
    models.model_save(loaded, "best_model", folder, spark)  # over itself
    loaded = models.model_load(spark, folder)
    out = {r.k: (r.y, r.predicted_label) for r in loaded.model.transform(df).collect()}
    assert len(out) == 120 and sum(a == b for a, b in out.values()) > 110
    assert predict.score(loaded.model, df, loaded.schema).columns == ["x", "s", "Prediction"]


def test_confusion_matrix_of_many_classes(spark):
    rows = [(f"c{i % 150}", f"c{(i * i) % 200}") for i in range(3000)] + [(None, "c1"), ("c2", None), (None, "only")]
    cells = {(r["actual"], r["predicted"]): r["count"] for r in V.confusion_matrix(spark.createDataFrame(rows, "y_true string, y_pred string")).collect()}
    known = {c for row in rows for c in row if c is not None}
    assert len(cells) == len(known) ** 2 and sum(cells.values()) == 3000
    assert all(n == rows.count(k) for k, n in list(cells.items())[:200])
    assert V.confusion_matrix(spark.createDataFrame([], "y_true string, y_pred string")).count() == 0


def test_solvers_get_partitions_by_rows(spark, monkeypatch):
    assert E.partitions_for(10, 5) == 1 and E.partitions_for(10**9, 1) * E.PARTITION_BYTES >= 24 * 10**9
    seen = []
    monkeypatch.setattr(E, "PARTITION_BYTES", 800)
    monkeypatch.setattr(E.Pipeline, "fit", lambda self, df: seen.append(df.rdd.getNumPartitions()))
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=["x"], outputCol="features").transform(spark.range(200).selectExpr("double(id % 2) label", "double(id) x").coalesce(1))
    E.fit("Logistic Regression", E.FitContext(rows, "classification", 2))
    assert seen == [6]
