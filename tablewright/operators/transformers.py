"""Two feature maps that Spark ML lacks, and linear machines on one of them, usable and savable in a pipeline."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasOutputCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F


class RandomThresholds(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Each feature becomes 0/1 tests against cut points drawn at random.

    A forest that picks among a random subset of such tests at every node splits
    at random thresholds, which is what sets extremely randomized trees apart.
    """

    thresholds = Param(Params._dummy(), "thresholds", "one cut point per test", TypeConverters.toListFloat)
    owners = Param(Params._dummy(), "owners", "feature of each test", TypeConverters.toListInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, thresholds=None, owners=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        pairs = zip(self.getOrDefault(self.owners), self.getOrDefault(self.thresholds))
        tests = F.array(*[F.struct(F.lit(o).alias("owner"), F.lit(t).alias("cut")) for o, t in pairs])
        x = vector_to_array(self.getInputCol())
        # The vector is unpacked once, as a one-element array, not once per test.
        bits = F.transform(F.array(x), lambda v: F.transform(tests, lambda t: F.when(v[t["owner"]] > t["cut"], 1.0).otherwise(0.0)))
        return df.withColumn(self.getOutputCol(), array_to_vector(bits[0]))


class RandomFourier(Transformer, HasInputCol, HasOutputCol, DefaultParamsReadable, DefaultParamsWritable):
    """Random Fourier features of a Gaussian kernel (Rahimi and Recht, 2007)."""

    gamma = Param(Params._dummy(), "gamma", "kernel width parameter", TypeConverters.toFloat)
    components = Param(Params._dummy(), "components", "number of features", TypeConverters.toInt)
    size = Param(Params._dummy(), "size", "length of the input vector", TypeConverters.toInt)
    randomSeed = Param(Params._dummy(), "randomSeed", "seed of the projection", TypeConverters.toInt)

    @keyword_only
    def __init__(self, inputCol=None, outputCol=None, gamma=None, components=None, size=None, randomSeed=None):
        super().__init__()
        self._set(**self._input_kwargs)

    def phases(self):
        """Weights of the columns, with the offsets below them, whose cosines are the features, and the height of these."""
        import numpy as np

        count, size = self.getOrDefault(self.components), self.getOrDefault(self.size)
        rng = np.random.RandomState(self.getOrDefault(self.randomSeed))
        weights = rng.normal(scale=np.sqrt(2 * self.getOrDefault(self.gamma)), size=(size, count))
        return np.vstack([weights, rng.uniform(0, 2 * np.pi, size=count)]), np.sqrt(2.0 / count)

    def waves(self):
        """Function matrix of rows -> their features."""
        import numpy as np

        phases, high = self.phases()
        return lambda x: high * np.cos(x @ phases[:-1] + phases[-1])

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        waves = self.waves()

        @F.pandas_udf("array<double>")
        def project(vectors):
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            x = np.stack(vectors.to_numpy()).astype(float)
            return pd.Series(list(waves(x)))

        return df.withColumn(self.getOutputCol(), array_to_vector(project(vector_to_array(self.getInputCol()))))


STEP_ROWS = 1024
MACHINE_ROWS = 250_000  # in a task


def descend(x, steps: int = 100, tol: float = 1e-6, memory: int = 10):
    """Generator that yields points and is sent their (value, gradient); returns the best point and its value.

    Limited-memory BFGS with a weak Wolfe search by halving, which goes on at kinks (Lewis and Overton, 2013). Ends when ten steps have
    lowered the value by less than the share ``tol``.
    """
    import math

    import numpy as np

    f, g = yield x
    pairs, values = [], [f]
    for _ in range(steps):
        d, kept = -g, []
        for s, y in reversed(pairs):
            a = (s @ d) / (s @ y)
            d = d - a * y
            kept.append(a)
        if pairs:
            s, y = pairs[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(pairs, reversed(kept)):
            d = d + (a - (y @ d) / (s @ y)) * s
        if not g @ d < 0:
            pairs, d = [], -g
        slope = g @ d
        if -slope <= 1e-14 * max(1.0, abs(f)):
            break
        low, high, t, best = 0.0, math.inf, 1.0 if pairs else 1.0 / math.sqrt(-slope), None
        for _ in range(30):
            at, (value, grad) = x + t * d, (yield x + t * d)
            if value > f + 1e-4 * t * slope:
                high = t
            else:
                if best is None or value < best[1]:
                    best = (at, value, grad)
                if grad @ d >= 0.9 * slope:
                    best = (at, value, grad)
                    break
                low = t
            t = (low + high) / 2 if high < math.inf else 2 * t
        if best is None:
            break
        s, y = best[0] - x, best[2] - g
        if s @ y > 1e-12 * np.sqrt((s @ s) * (y @ y)):
            pairs = [*pairs, (s, y)][-memory:]
        x, f, g = best
        values.append(f)
        if len(values) > 10 and values[-11] - f <= tol * abs(f):
            break
    return x, f


class FourierMachines(Estimator):
    """A linear support vector machine for each class against the rest, on the features of ``fourier``: mean hinge loss and
    ``penalty`` / 2 times the squared weights, the intercept free.

    The rows stay as they came in, packed, and their features are made again, in single precision, in each pass; sums are in double
    precision. A pass serves the machines of all classes, so its result is a gradient for each of them, whatever the rows.
    """

    def __init__(self, fourier: RandomFourier, classes: int, penalty: float, rows: int) -> None:
        super().__init__()
        self.fourier, self.classes, self.penalty, self.rows = fourier, classes, penalty, rows

    def _fit(self, df: DataFrame) -> "FourierMachinesModel":
        import numpy as np

        spark, size = df.sparkSession, self.fourier.getOrDefault("size")
        phases, high = self.fourier.phases()
        phases = phases.astype(np.float32)
        count, classes, rows = self.fourier.getOrDefault("components"), self.classes, self.rows

        def pack(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    x = np.asarray(batch.column(0).flatten(), dtype=np.float32).reshape(batch.num_rows, -1)
                    x = np.hstack([x, np.ones((len(x), 1), np.float32)])  # for the offsets
                    y = np.asarray(batch.column(1), dtype=np.int32)
                    yield pa.RecordBatch.from_arrays([pa.array([v.tobytes()], pa.binary()) for v in (x, y)], ["x", "y"])

        own = df.select(vector_to_array(self.fourier.getInputCol()).alias("x"), "label")
        parts = max(spark.sparkContext.defaultParallelism, -(-rows // MACHINE_ROWS))
        blocks = own.mapInArrow(pack, "x binary, y binary").repartition(parts).rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)

        def passed(points, asked):
            """(value, gradient) of the loss of each asked class at its point."""

            def add(part):
                room_for = np.empty((STEP_ROWS, count), np.float32)
                weights, sums = (points[:, :count] * high).astype(np.float32), np.zeros((len(asked), count + 2))
                for x, y in part:
                    x, y = np.frombuffer(x, np.float32).reshape(-1, size + 1), np.frombuffer(y, np.int32)
                    for i in range(0, len(y), STEP_ROWS):
                        z = np.matmul(x[i : i + STEP_ROWS], phases, out=room_for[: len(x[i : i + STEP_ROWS])])
                        np.cos(z, out=z)
                        sign = np.where(y[i : i + STEP_ROWS] == asked[:, None], 1.0, -1.0)
                        room = 1.0 - sign * ((weights @ z.T).astype(float) + points[:, count, None])
                        pull = np.where(room > 0, -sign, 0.0)
                        sums[:, :count] += pull.astype(np.float32) @ z
                        sums[:, count] += pull.sum(1)
                        sums[:, count + 1] += np.maximum(room, 0.0).sum(1)
                sums[:, :count] *= high
                yield sums

            sums = sum(blocks.mapPartitions(add).collect()) / rows
            out = []
            for point, s in zip(points, sums):
                w = np.r_[point[:count], 0.0]
                out.append((s[count + 1] + self.penalty / 2 * (w @ w), s[: count + 1] + self.penalty * w))
            return out

        searches = {k: descend(np.zeros(count + 1)) for k in range(classes)}
        points, found = {k: next(s) for k, s in searches.items()}, {}
        while points:
            asked = np.array(sorted(points))
            for k, told in zip(asked.tolist(), passed(np.stack([points[k] for k in asked.tolist()]), asked)):
                try:
                    points[k] = searches[k].send(told)
                except StopIteration as end:
                    found[k] = end.value[0]
                    del points[k]
        blocks.unpersist()
        told = {p.name: v for p, v in self.fourier.extractParamMap().items() if p.name != "outputCol"}
        return FourierMachinesModel(**told, machines=np.concatenate([found[k] for k in range(classes)]).tolist())


class FourierMachinesModel(RandomFourier):
    """Adds rawPrediction, the margin of each class, and prediction, the class of the largest."""

    machines = Param(Params._dummy(), "machines", "weights and intercept of each class, one after the other", TypeConverters.toListFloat)

    @keyword_only
    def __init__(self, inputCol=None, gamma=None, components=None, size=None, randomSeed=None, machines=None):
        Transformer.__init__(self)
        self._set(**self._input_kwargs)

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        waves, machines = self.waves(), np.array(self.getOrDefault(self.machines)).reshape(-1, self.getOrDefault(self.components) + 1)

        @F.pandas_udf("array<double>")
        def margins(vectors):
            import pandas as pd

            parts = [vectors.iloc[i : i + STEP_ROWS] for i in range(0, len(vectors), STEP_ROWS)]
            return pd.Series([m for p in parts for m in waves(np.stack(p.to_numpy()).astype(float)) @ machines[:, :-1].T + machines[:, -1]], dtype=object)

        out = df.withColumn("__margins", margins(vector_to_array(self.getInputCol())))
        best = (F.array_position("__margins", F.array_max("__margins")) - 1).cast("double")
        return out.withColumn("rawPrediction", array_to_vector("__margins")).withColumn("prediction", best).drop("__margins")
