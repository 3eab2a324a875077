import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import functions as F

from tablewright.operators.transformers import FourierMachines, FourierMachinesModel, RandomFourier


def test_machines_reach_the_least_loss_and_are_saved(spark, tmp_path):
    random = np.random.RandomState(4)
    x = random.normal(size=(1_500, 3))
    y = np.where(random.random_sample(1_500) < 0.1, random.randint(0, 3, 1_500), (x[:, 0] > 0) + (x[:, 1] > 0.3 * x[:, 2]))
    rows = spark.createDataFrame([(*map(float, v), float(k)) for v, k in zip(x, y)], "a double, b double, c double, label double").repartition(4)
    df = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows).cache()
    fourier = RandomFourier(inputCol="features", outputCol="waves", gamma=0.3, components=40, size=3, randomSeed=1)
    penalty = 1.0 / 1_500
    model = Pipeline(stages=[FourierMachines(fourier, 3, penalty, 1_500)]).fit(df)
    own = np.array(model.stages[0].getOrDefault("machines")).reshape(3, 41)
    z, told = fourier.waves()(np.array([r.features.toArray() for r in df.collect()])), np.array([r.label for r in df.collect()])

    def loss(w, b, k):
        return np.maximum(0, 1 - np.where(told == k, 1, -1) * (z @ w + b)).mean() + penalty / 2 * (w @ w)

    waves = fourier.transform(df).cache()
    for k in range(3):
        one = LinearSVC(featuresCol="waves", labelCol="one", regParam=penalty, standardization=False).fit(waves.withColumn("one", (F.col("label") == k).cast("double")))
        assert loss(own[k, :40], own[k, 40], k) <= 1.002 * loss(one.coefficients.toArray(), one.intercept, k)
    out = model.transform(df).select("features", "rawPrediction", "prediction").collect()
    margins = fourier.waves()(np.array([r.features.toArray() for r in out])) @ own[:, :40].T + own[:, 40]
    assert np.allclose([r.rawPrediction.toArray() for r in out], margins) and [r.prediction for r in out] == margins.argmax(1).tolist()
    model.write().overwrite().save(str(tmp_path / "m"))
    again = PipelineModel.load(str(tmp_path / "m"))
    assert isinstance(again.stages[0], FourierMachinesModel) and again.transform(df).select("prediction").collect() == model.transform(df).select("prediction").collect()


def test_labels_that_say_nothing_end_the_search(spark):
    random = np.random.RandomState(1)
    rows = spark.createDataFrame([(*map(float, v), float(i % 3)) for i, v in enumerate(random.normal(size=(900, 2)))], "a double, b double, label double")
    df = rows.select(array_to_vector(F.array("a", "b")).alias("features"), "label")
    fourier = RandomFourier(inputCol="features", outputCol="waves", gamma=0.5, components=20, size=2, randomSeed=1)
    model = FourierMachines(fourier, 3, 1.0 / 900, 900).fit(df)
    margins = [r.m for r in model.transform(df).select(vector_to_array("rawPrediction").alias("m")).collect()]
    assert np.mean(np.array(margins) < 0) > 0.9  # each class is the rarer side
