import numpy as np
import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tablewright.operators import trees
from tablewright.operators.boosting import BoostedTrees


@pytest.fixture(scope="module")
def table(spark):
    random = np.random.RandomState(4)
    x = np.column_stack([random.randint(0, 12, 300), random.randint(0, 2, 300), random.randint(0, 30, 300)]).astype(float)
    y = 3 * x[:, 0] + 10 * x[:, 1] * (x[:, 2] > 15) + random.normal(size=300)
    rows = spark.createDataFrame([(*map(float, a), float(b)) for a, b in zip(x, y)], "a double, b double, c double, label double")
    return x, y, VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).repartition(4)


def plain(x, y, rounds, step, depth, leaves, least, l2):
    """Every cut of every open leaf, the one of the highest gain first."""
    pred = np.full(len(y), y.mean())
    score = lambda g: g.sum() ** 2 / (len(g) + l2)
    for _ in range(rounds):
        g = pred - y
        open_, done = [(np.arange(len(y)), 0)], []
        while open_ and len(open_) + len(done) < leaves:
            options = []
            for k, (rows, level) in enumerate(open_):
                for f in range(x.shape[1]):
                    for cut in np.unique(x[rows, f])[:-1]:
                        left = x[rows, f] <= cut
                        if level < depth and left.sum() >= least and (~left).sum() >= least:
                            options.append((score(g[rows[left]]) + score(g[rows[~left]]) - score(g[rows]), k, rows[left], rows[~left], level + 1))
            best = max(options, key=lambda o: o[0], default=None)
            if best is None or best[0] <= 1e-12:
                break
            del open_[best[1]]
            open_ += [(best[2], best[4]), (best[3], best[4])]
        for rows, _ in open_ + done:
            pred[rows] -= step * g[rows].sum() / (len(rows) + l2)
    return pred


@pytest.mark.parametrize("settings", [
    {"rounds": 2, "step": 0.3, "depth": 3, "leaves": 1 << 30, "least": 1, "l2": 1.0}, {"rounds": 2, "step": 0.5, "depth": 64, "leaves": 7, "least": 20, "l2": 0.0},
])
def test_trees_are_those_of_all_cuts(table, settings):
    x, y, df = table
    got = BoostedTrees(**settings).fit(df).transform(df).select("label", "prediction").collect()
    want = dict(zip(np.round(y, 9), plain(x, y, **settings)))
    assert all(r.prediction == pytest.approx(want[round(r.label, 9)], abs=1e-9) for r in got)


def test_saved_model(spark, table, tmp_path, monkeypatch):
    from tablewright.operators import boosting

    monkeypatch.setattr(boosting, "REFRESH", 3)  # rows are written again on the way
    _, _, df = table
    model = Pipeline(stages=[BoostedTrees(rounds=8, step=0.3, depth=4)]).fit(df)
    model.write().overwrite().save(str(tmp_path / "m"))
    loss = lambda m: m.transform(df).agg(F.avg((F.col("label") - F.col("prediction")) ** 2)).first()[0]
    own = loss(model)
    assert loss(PipelineModel.load(str(tmp_path / "m"))) == pytest.approx(own)
    assert own < 0.05 * df.agg(F.var_pop("label")).first()[0]
    importances = model.stages[0].featureImportances.toArray()
    assert importances.sum() == pytest.approx(1) and importances.argmax() != 1


def test_tables_without_a_split(spark, table):
    _, _, df = table
    one = spark.createDataFrame([df.first()], df.schema)
    assert {r.prediction for r in BoostedTrees(rounds=3).fit(one).transform(df).collect()} == {one.first().label}
    same = df.withColumn("label", F.lit(2.0))
    assert {r.prediction for r in BoostedTrees(rounds=3).fit(same).transform(df).collect()} == {2.0}
    with pytest.raises(ValueError):
        BoostedTrees().fit(df.limit(0))


@pytest.mark.parametrize("classes", [0, 3])
def test_rows_of_the_same_codes_are_one_row(spark, classes):
    random = np.random.RandomState(8)
    x = random.randint(0, 6, (80, 2))
    y = random.randint(0, 3, 80) if classes else np.round(x.sum(1) + random.normal(size=80), 3)
    rows = spark.createDataFrame([(float(a), float(b), float(v)) for (a, b), v in zip(x, y)], "a double, b double, label double")
    df = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(rows)
    own = df.selectExpr("array(a, b) as x", "label as y")
    layout = trees.fit_codes(own, 255)
    packed = trees.pack_labels(trees.group_rows(own, layout, bool(classes)), 2).collect()
    assert sum(r.cells for r in packed) == len({(*v, k) if classes else tuple(v) for v, k in zip(x.tolist(), y.tolist())})
    assert sum(np.frombuffer(r.n).sum() for r in packed) == 80
    told = lambda m, d: {(r.a, r.b): r.prediction for r in m.transform(d).collect()}
    once = told(BoostedTrees(rounds=5, depth=2, l2=0.0, classes=classes).fit(df), df)
    assert told(BoostedTrees(rounds=5, depth=2, l2=0.0, classes=classes).fit(df.union(df).union(df)), df) == pytest.approx(once)
