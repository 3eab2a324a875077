"""Boosted trees: histograms of gradients and hessians, leaf weights -G / (H + l2).

Rows hold small codes (`trees.py`), how many rows of these codes they stand for (for numbers with the mean of their labels, as gradients
of the squared error add up; for classes by label), and their predictions, in blocks kept by the engine. A pass over the blocks adds up rows,
gradients and, for classes, hessians by (node, column, code) in each task; the engine merges the tasks' sums, whose number the rows
do not change, and the driver takes the best cut of each node from them. All nodes of a level share a pass, for classes those of all
trees of a round.

With a limit on leaves, splits are taken in the order of their gain. A node's best split does not depend on that order,
so levels are still grown together: only nodes that the order can reach are looked at, and a tree ends when it reaches
no unknown one. The loss is the squared error, or for classes the deviance, with a tree for each class beyond two.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, stage
from .trees import Codes, Rule, Tree, choose, fit_codes, group_rows, merged, pack_labels, partitions, place, unpack

REFRESH = 20  # trees after which the rows are written again with their predictions


def gradients(pred, y, classes: int):
    """(outputs x rows) gradients, and for classes hessians of the leaf weights."""
    import numpy as np

    if not classes:
        return pred - y[None], None
    if classes == 2:
        g = 1.0 / (1.0 + np.exp(-pred)) - y[None]
    else:
        e = np.exp(pred - pred.max(0))
        g = e / e.sum(0) - (y[None] == np.arange(classes)[:, None])
    return g, np.abs(g) * (1.0 - np.abs(g))


class Growing:
    """One tree on its way: which nodes the next pass looks at, and what it found."""

    def __init__(self, leaves: int, depth: int) -> None:
        self.tree, self.leaves, self.depth = Tree(), leaves, depth
        self.sums, self.level = {}, {0: 0}
        self.known: dict[int, tuple[float, int, int] | None] = {}
        self.taken: list[int] = []
        self.asked = [0]

    def learn(self, node: int, totals, cut) -> None:
        """``cut``: column, code, gain and sums of the left side, or None."""
        self.sums[node] = totals
        if cut is None or cut[2] <= 1e-12:
            self.known[node] = None
            return
        column, code, gain, left = cut
        child = self.tree.split(node, column, code)
        self.sums[child], self.sums[child + 1] = left, totals - left
        self.level[child] = self.level[child + 1] = self.level[node] + 1
        self.known[node] = (gain, column, code)

    def turn(self) -> None:
        """Take splits by gain; a node that this reaches and that is not known yet is looked at in the next pass."""
        heap, taken, asked = [(-self.known[0][0], 0)] if self.known[0] else [], [], []
        while heap and len(taken) < self.leaves - 1:
            _, node = heapq.heappop(heap)
            taken.append(node)
            for child in (self.tree.child[node], self.tree.child[node] + 1):
                if self.level[child] >= self.depth:
                    continue
                if child not in self.known:
                    asked.append(child)
                elif self.known[child] is not None:
                    heapq.heappush(heap, (-self.known[child][0], child))
        self.taken, self.asked = taken, asked

    def final(self, weight) -> Tree:
        """The splits that were taken, numbered anew, with the weights of the ends."""
        out, numbers = Tree(), {0: 0}
        out.value[0] = weight(self.sums[0])
        for node in sorted(self.taken):
            _, column, code = self.known[node]
            child, own = self.tree.child[node], out.split(numbers[node], column, code)
            for side in (0, 1):
                numbers[child + side] = own + side
                out.value[own + side] = weight(self.sums[child + side])
        return out


class BoostedTrees(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Boosted trees for numbers, or for ``classes`` numbered from 0. ``leaves`` limits a tree in the order of gains, ``depth`` by levels.

    The first prediction is the mean of the labels, for classes the logarithm of their shares. Rows with a null label or vector
    are errors of the preparation before.
    """

    rounds = Param(Params._dummy(), "rounds", "trees", TypeConverters.toInt)
    step = Param(Params._dummy(), "step", "share of a leaf weight that is added", TypeConverters.toFloat)
    depth = Param(Params._dummy(), "depth", "levels of a tree at most", TypeConverters.toInt)
    leaves = Param(Params._dummy(), "leaves", "leaves of a tree at most", TypeConverters.toInt)
    least = Param(Params._dummy(), "least", "rows of a leaf at least", TypeConverters.toInt)
    l2 = Param(Params._dummy(), "l2", "added to the hessian of a leaf", TypeConverters.toFloat)
    bins = Param(Params._dummy(), "bins", "bins of a feature, 256 at most", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)

    @keyword_only
    def __init__(self, rounds=100, step=0.3, depth=6, leaves=1 << 30, least=1, l2=1.0, bins=255, classes=0):
        super().__init__()
        self._setDefault(featuresCol="features", labelCol="label", predictionCol="prediction")
        self._set(**self._input_kwargs)
        self._setDefault(rounds=100, step=0.3, depth=6, leaves=1 << 30, least=1, l2=1.0, bins=255, classes=0)

    def _fit(self, df: DataFrame) -> "BoostedTreesModel":
        import numpy as np

        spark, classes = df.sparkSession, self.getOrDefault(self.classes)
        depth, leaves, l2, step = (self.getOrDefault(p) for p in (self.depth, self.leaves, self.l2, self.step))
        own = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        sizes = [F.count_if(F.col("y") == k).alias(f"c{k}") for k in range(classes)]
        facts = own.agg(F.avg("y").alias("mean"), F.count("*").alias("rows"), *sizes).first()
        if not facts.rows:
            raise ValueError("no training rows")
        shares = np.array([max(facts[f"c{k}"], 1e-9) / facts.rows for k in range(classes)])
        base = [facts.mean or 0.0] if not classes else [float(math.log(shares[1] / shares[0]))] if classes == 2 else np.log(shares).tolist()
        outputs, entries, rule = len(base), 3 if classes else 2, Rule(l2=l2, least=self.getOrDefault(self.least))
        layout = fit_codes(own, min(self.getOrDefault(self.bins), 256))
        width, widths, indicators = len(layout.groups), layout.widths, layout.indicators
        offsets = np.r_[0, np.cumsum(widths)].astype(int)
        packed = stage(pack_labels(group_rows(own, layout, bool(classes)), width), "boosting-rows")
        size, blocks = packed.agg(F.sum("cells"), F.count("*")).first()

        def begin(r):
            return r.codes, r.told, r.n, np.repeat(np.array(base)[:, None], len(r.told) // 8, 1).tobytes()

        def weight(sums) -> list[float]:
            if not classes:
                return [-step * sums[1] / (sums[0] + l2)]
            factor = 1.0 if classes == 2 else (classes - 1) / classes
            return [-step * factor * sums[1] / (sums[2] + l2) if sums[2] > 1e-150 else 0.0]

        def updated(rows, last):
            def run(part):
                for codes, told, n, pred in part:
                    pred, x = np.frombuffer(pred).reshape(outputs, -1).copy(), unpack(codes, len(told) // 8, width)
                    for k, tree in enumerate(last):
                        pred[k] += tree[3][place(x, indicators, tree), 0]
                    yield codes, told, n, pred.tobytes()

            return rows.mapPartitions(run, preservesPartitioning=True)

        def passed(rows, growing):
            """Sums of the asked nodes of all outputs, in their order."""
            arrays, asked = [g.tree.arrays()[:3] for g in growing], [g.asked for g in growing]
            size = sum(map(len, asked))

            def add(part):
                sums = np.zeros((size, int(offsets[-1]), entries))
                for codes, told, n, pred in part:
                    y, n = np.frombuffer(told), np.frombuffer(n)
                    codes = unpack(codes, len(y), width)
                    g, h = gradients(np.frombuffer(pred).reshape(outputs, -1), y, classes)
                    first = 0
                    for k, nodes in enumerate(asked):
                        if nodes:
                            slots = np.full(len(arrays[k][0]), -1)
                            slots[nodes] = np.arange(len(nodes))
                            at = slots[place(codes, indicators, arrays[k])]
                            used = np.flatnonzero(at >= 0)
                            at, w = at[used], n[used]
                            stats = [w, w * g[k, used]] + ([w * h[k, used]] if classes else [])
                            for c, wide in enumerate(widths):
                                key = at * wide + codes[used, c]
                                for e, s in enumerate(stats):
                                    sums[first : first + len(nodes), offsets[c] : offsets[c + 1], e] += np.bincount(key, s, len(nodes) * wide).reshape(-1, wide)
                        first += len(nodes)
                yield sums

            sums = rows.mapPartitions(add)
            return sums.treeReduce(merged, 2) if count > 8 else sums.reduce(merged)

        level = StorageLevel.MEMORY_AND_DISK
        count = partitions(spark, size, blocks)
        rows = packed.repartition(count).rdd.map(begin).persist(level)
        trees, before = [[] for _ in range(outputs)], None
        for done in range(self.getOrDefault(self.rounds) if width else 0):
            growing = [Growing(leaves, depth) for _ in range(outputs)]
            while any(g.asked for g in growing):
                sums = passed(rows, growing)
                if before is not None:
                    before.unpersist()
                    before = None
                totals, parts = sums[:, offsets[0] : offsets[1]].sum(1), []
                for c, wide in enumerate(widths):
                    flat = sums[:, offsets[c] : offsets[c + 1]].reshape(-1, entries)
                    found = np.flatnonzero(flat[:, 0])
                    parts.append((found, flat[found]))
                cuts = choose(parts, totals, np.ones(len(totals), bool), layout, rule, None, 1)
                best = {int(s): (int(c), int(v), float(gain), left) for s, c, v, gain, left in zip(*cuts)}
                slot = 0
                for g in growing:
                    for node in g.asked:
                        g.learn(node, totals[slot], best.get(slot))
                        slot += 1
                    if g.asked:
                        g.turn()
            last = [g.final(weight) for g in growing]
            if not any(t.column[0] >= 0 for t in last):
                break
            for k, tree in enumerate(last):
                trees[k].append(tree)
            before, rows = rows, updated(rows, [t.arrays() for t in last])
            if (done + 1) % REFRESH == 0:  # a written table ends the chain of updates
                path = scratch_path(spark, "boosting-rows")
                schema = "codes binary, told binary, n binary, pred binary"
                spark.createDataFrame(rows.map(lambda r: tuple(map(bytearray, r))), schema).write.parquet(path)
                before.unpersist()
                before, rows = None, spark.read.schema(schema).parquet(path).repartition(count).rdd.map(
                    lambda r: (bytes(r.codes), bytes(r.told), bytes(r.n), bytes(r.pred))
                )
            rows = rows.persist(level)
        rows.unpersist()
        if before is not None:
            before.unpersist()
        listed = [[[t.column, t.code, t.child, [v[0] for v in t.value]] for t in own_] for own_ in trees]
        document = json.dumps({"base": base, "cuts": layout.cuts, "groups": layout.groups, "indicators": indicators, "classes": classes, "trees": listed})
        return BoostedTreesModel(document=document, featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


class BoostedTreesModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Fitted trees: their size is bounded by the rounds and the leaves, not by the rows."""

    document = Param(Params._dummy(), "document", "base, codes and trees", TypeConverters.toString)

    @keyword_only
    def __init__(self, document=None, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._set(**self._input_kwargs)
        self._setDefault(featuresCol="features", predictionCol="prediction")

    @property
    def featureImportances(self):
        """Share of all splits that each feature has."""
        import numpy as np
        from pyspark.ml.linalg import Vectors

        d = json.loads(self.getOrDefault(self.document))
        layout, counts = Codes(d["cuts"], d["groups"], d["indicators"]), np.zeros(len(d["cuts"]))
        for own in d["trees"]:
            for column, code, _, _ in own:
                column, code = np.array(column), np.array(code)
                inner = column >= 0
                np.add.at(counts, layout.features(column[inner], code[inner]), 1.0)
        return Vectors.dense((counts / (counts.sum() or 1.0)).tolist())

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        d = json.loads(self.getOrDefault(self.document))
        layout, base, classes = Codes(d["cuts"], d["groups"], d["indicators"]), d["base"], d["classes"]
        trees = [
            [(np.array(a, np.int16), np.array(b, np.uint8), np.array(c, np.int32), np.array(v, float)) for a, b, c, v in own] for own in d["trees"]
        ]

        @F.pandas_udf("array<double>")
        def predict(vectors):
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            codes = layout.encode(np.stack(vectors.to_numpy()).astype(float))
            out = np.stack([b + sum((t[3][place(codes, layout.indicators, t)] for t in own), np.zeros(len(codes))) for b, own in zip(base, trees)], 1)
            if classes == 2:
                p = 1.0 / (1.0 + np.exp(-out[:, 0]))
                out = np.stack([1.0 - p, p], 1)
            elif classes:
                e = np.exp(out - out.max(1, keepdims=True))
                out = e / e.sum(1, keepdims=True)
            return pd.Series(list(out))

        out = df.withColumn("__values", predict(vector_to_array(self.getFeaturesCol())))
        if not classes:
            return out.withColumn(self.getPredictionCol(), F.col("__values")[0]).drop("__values")
        best = (F.array_position("__values", F.array_max("__values")) - 1).cast("double")
        return out.withColumn("probability", array_to_vector("__values")).withColumn(self.getPredictionCol(), best).drop("__values")
