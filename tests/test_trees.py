import json

import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tablewright.operators import trees
from tablewright.operators.boosting import BoostedTrees
from tablewright.operators.trees import Codes, Forest


@pytest.fixture(scope="module")
def table(spark):
    """A number of 120 values, its label known from each of them, three indicators of a category and one apart."""
    random = np.random.RandomState(5)
    value, kind, flag = random.permutation(np.arange(600) % 120), random.randint(0, 4, 600), random.randint(0, 2, 600)
    goal = random.randint(0, 3, (120, 4, 2))
    rows = [(float(v), *(float(k == i) for i in range(3)), float(f), float(goal[v, k, f])) for v, k, f in zip(value, kind, flag)]
    names = ["v", "k0", "k1", "k2", "f", "label"]
    df = VectorAssembler(inputCols=names[:5], outputCol="features").transform(spark.createDataFrame(rows, [*names])).repartition(3)
    return df.select("features", "label").cache()


def answers(model, df):
    return sorted((r.features.toArray().tolist(), r.label, r.prediction) for r in model.transform(df).collect())


@pytest.mark.parametrize("classes", [0, 3])
def test_a_tree_tells_every_value_apart(table, classes):
    assert all(label == pytest.approx(p) for _, label, p in answers(Forest(classes=classes).fit(table), table))


@pytest.mark.parametrize("classes", [0, 3])
def test_nodes_split_by_level_are_those_of_one_task(table, classes, monkeypatch):
    if not classes:  # labels that leave no two cuts equally good
        table = table.withColumn("label", F.col("label") + F.sin(F.xxhash64(vector_to_array("features")) % 1000))
    own = answers(Forest(classes=classes, depth=6).fit(table), table)
    monkeypatch.setattr(trees, "LOCAL_ROWS", 40)
    monkeypatch.setattr(trees, "PASS_CELLS", 500)  # several passes a level
    assert [p for *_, p in answers(Forest(classes=classes, depth=6).fit(table), table)] == pytest.approx([p for *_, p in own])


def test_first_cut_is_the_best_of_all(table):
    rows = [(r.features.toArray(), r.label) for r in table.collect()]
    x, y = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    split = lambda f, c: sum(((s - s.mean()) ** 2).sum() for s in (y[x[:, f] <= c], y[x[:, f] > c]))
    _, f, c = min((split(f, c), f, c) for f in range(5) for c in np.unique(x[:, f])[:-1])
    want = np.where(x[:, f] <= c, y[x[:, f] <= c].mean(), y[x[:, f] > c].mean())
    got = {tuple(a): p for a, _, p in answers(Forest(depth=1).fit(table), table)}
    assert [got[tuple(a)] for a in x.tolist()] == pytest.approx(want)


@pytest.mark.parametrize("settings", [{"bootstrap": True, "subset": 2}, {"random": True, "subset": 2}])
def test_forests(spark, table, settings, tmp_path, monkeypatch):
    monkeypatch.setattr(trees, "LOCAL_ROWS", 150)
    monkeypatch.setattr(trees, "DEALT_ROWS", 3000)  # trees are dealt in groups
    model = Pipeline(stages=[Forest(classes=3, trees=20, **settings)]).fit(table)
    own = answers(model, table)
    assert np.mean([label == p for _, label, p in own]) > 0.8
    shares = [r.probability.toArray() for r in model.transform(table).collect()]
    assert len(shares) == 600 and np.allclose(np.sum(shares, 1), 1.0)
    assert model.stages[0].featureImportances.toArray().sum() == pytest.approx(1.0)
    model.write().overwrite().save(str(tmp_path / "m"))
    assert answers(PipelineModel.load(str(tmp_path / "m")), table) == own


def test_indicators_share_a_column():
    layout = Codes([[1.5, 3.0], [0.0], [0.0]], [[0], [1, 2]], [False, True])
    x = np.array([[1.5, 0, 0], [2.0, 1, 0], [9.0, 0, 1]])
    assert layout.encode(x).tolist() == [[0, 0], [1, 1], [2, 2]]
    assert layout.features(np.array([0, 1, 1]), np.array([1, 1, 2])).tolist() == [0, 1, 2]


def test_indicators_that_meet_stay_apart(spark):
    meet = spark.createDataFrame([([1.0, 0.0, 0.0],), ([0.0, 1.0, 1.0],), ([0.0, 0.0, 1.0],)], "x array<double>")
    assert trees.fit_codes(meet, 255).groups == [[0, 1], [2]]


@pytest.mark.parametrize("classes", [2, 3])
def test_boosted_classes(table, classes):
    df = table.withColumn("label", (table.label > 0).cast("double")) if classes == 2 else table
    model = BoostedTrees(rounds=40, step=0.3, depth=4, l2=0.0, classes=classes).fit(df)
    out = model.transform(df).collect()
    assert all(r.probability.toArray().sum() == pytest.approx(1.0) and r.prediction == r.probability.toArray().argmax() for r in out)
    assert np.mean([r.label == r.prediction for r in out]) > 0.8


def test_boosted_classes_begin_with_their_shares(table):
    model = BoostedTrees(rounds=0, classes=3).fit(table)
    labels = [r.label for r in table.collect()]
    assert model.transform(table).first().probability.toArray() == pytest.approx([labels.count(k) / len(labels) for k in range(3)])


@pytest.mark.parametrize("classes", [0, 3])
def test_rows_of_the_same_codes_are_one_cell(spark, table, classes, monkeypatch):
    copies = table.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(5)))).drop("copy")
    rows = copies.select(vector_to_array("features").alias("x"), F.col("label").alias("y"))
    layout = trees.fit_codes(rows, 255)
    equal = trees.group_rows(rows, layout, True).cache()
    packed, labelled, cells = trees.pack_cells(spark, equal, len(layout.groups))
    vectors = len({tuple(r.features.toArray()) for r in table.collect()})
    assert (labelled, cells) == (vectors, vectors) and sum(np.frombuffer(r.n).sum() for r in packed.collect()) == 3_000
    # One task grows them, though the rows are more than it may have; and copies change no tree.
    monkeypatch.setattr(trees, "LOCAL_ROWS", 600)
    own = {tuple(x): p for x, _, p in answers(Forest(classes=classes, depth=4).fit(table), table)}
    model = Forest(classes=classes, depth=4).fit(copies)
    assert len(json.loads(model.getOrDefault("document"))["tops"][0][0]) == 1
    assert {tuple(x): pytest.approx(p) for x, _, p in answers(model, copies)} == own


def test_labels_of_one_cell_are_dealt_and_drawn(spark, monkeypatch):
    monkeypatch.setattr(trees, "BLOCK_ROWS", 50)
    rows = spark.range(400).selectExpr("array(cast(id % 2 as double)) as x", "cast(id as double) as y")
    layout = trees.fit_codes(rows, 255)
    packed, labelled, cells = trees.pack_cells(spark, trees.group_rows(rows, layout, True).cache(), 1)
    assert labelled == 400 and cells > 2 and packed.count() > 1
    df = VectorAssembler(inputCols=["v"], outputCol="features").transform(rows.selectExpr("x[0] as v", "y as label"))
    out = {r.v: r.prediction for r in Forest(trees=30, bootstrap=True).fit(df).transform(df).select("v", "prediction").distinct().collect()}
    assert out[0.0] == pytest.approx(199.0, abs=10) and out[1.0] == pytest.approx(200.0, abs=10)
    assert {r.v: r.prediction for r in Forest().fit(df).transform(df).collect()} == pytest.approx({0.0: 199.0, 1.0: 200.0})
