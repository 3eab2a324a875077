"""Trees over rows of small codes: what decision trees, forests and boosted trees have in common, and forests.

A row holds one byte per column of codes. A number becomes the place of its bin; indicators that stand side by side and never
meet in a row, as those of one category column, share a column that says which of them is set. Sums by (node, column, code) give
every cut of every feature.

Rows of the same codes are never told apart by a cut. They are one cell, which has the sums of its rows, and a tree is grown on
cells: their number is bounded by the bins of the columns, however many rows there are. For a drawn sample a cell's rows of one
label are drawn together, as a sum of Poisson numbers is one.

A forest grows in two steps. Nodes with more than ``LOCAL_ROWS`` cells are split level by level: tasks add up the sums of
their blocks, the engine merges them, and the driver gets sums whose number the rows do not change. Smaller nodes of all
trees are then dealt over the cluster with their cells, and each is grown to its leaves in the task that gets it. These
subtrees stay a table; scoring deals the cells of the asked rows in the same way, meets them by a join, and joins the rows by their codes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import StorageLevel, keyword_only
from pyspark.ml import Estimator, Transformer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasFeaturesCol, HasLabelCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsReader, DefaultParamsWritable, DefaultParamsWriter
from pyspark.sql import DataFrame, functions as F

from ..session import scratch_path, stage

LOCAL_ROWS = 400_000  # cells of a node that one task grows to its leaves
LOCAL_BYTES = 64_000_000  # sums of all columns of such a node's cells, which bound its cells too
PASS_CELLS = 2_000_000  # sums of one pass
DEALT_ROWS = 40_000_000  # cells times trees that are dealt at once
PARTITION_ROWS = 250_000
BLOCK_ROWS = 40_000
FEATURES_PER_PASS = 40
ACCURACY = 10_000


# Codes


@dataclass
class Codes:
    """``groups`` lists the features of each column of codes; several are indicators that never meet in a row."""

    cuts: list[list[float]]  # ascending, by feature; a value up to a cut is left of it
    groups: list[list[int]]
    indicators: list[bool]  # by column

    @property
    def widths(self) -> list[int]:
        return [len(g) + 1 if own else len(self.cuts[g[0]]) + 1 for g, own in zip(self.groups, self.indicators)]

    def encode(self, x):
        import numpy as np

        out = np.zeros((len(x), len(self.groups)), np.uint8)
        for c, (group, own) in enumerate(zip(self.groups, self.indicators)):
            if own:
                for place, f in enumerate(group):
                    out[x[:, f] > 0.5, c] = place + 1
            else:
                out[:, c] = np.searchsorted(self.cuts[group[0]], x[:, group[0]], "left")
        return out

    def features(self, column, code):
        """Feature of each cut, given by its column and code."""
        import numpy as np

        first, own = np.array([g[0] for g in self.groups], int), np.array(self.indicators, bool)
        return first[column] + np.where(own[column], code - 1, 0)


def _array(column):
    """Matrix of an Arrow column of lists of one length."""
    import numpy as np

    return np.asarray(column.flatten(), dtype=float).reshape(len(column), -1)


def fit_codes(rows: DataFrame, bins: int, even: bool = False) -> Codes:
    """Codes of the vectors ``x``: bins between quantiles from sketches, or of equal width."""
    import numpy as np

    def look(batches: Iterator) -> Iterator:
        import pyarrow as pa

        low = high = flags = near = None
        for batch in batches:
            x = _array(batch.column(0))
            if not len(x):
                continue
            if low is None:
                low, high = np.full(x.shape[1], np.inf), np.full(x.shape[1], -np.inf)
                flags, near = np.ones(x.shape[1]), np.full(x.shape[1], -1.0)
            low, high = np.minimum(low, x.min(0)), np.maximum(high, x.max(0))
            flags *= ((x == 0) | (x == 1)).all(0)
            # The nearest indicator before, set in the same row.
            here = np.where((x == 1) & (flags == 1), np.arange(x.shape[1]), -1)
            before = np.maximum.accumulate(np.hstack([np.full((len(x), 1), -1), here[:, :-1]]), 1) if x.shape[1] else here
            near = np.maximum(near, np.where(x == 1, before, -1).max(0)) if x.shape[1] else near
        if low is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v.tolist()]) for v in (low, high, flags, near)], ["low", "high", "flags", "near"])

    facts = rows.select("x").mapInArrow(look, "low array<double>, high array<double>, flags array<double>, near array<double>")
    sides = facts.select(F.posexplode(F.arrays_zip("low", "high", "flags", "near"))).groupBy("pos").agg(
        F.min("col.low").alias("low"), F.max("col.high").alias("high"), F.min("col.flags").alias("flag"), F.max("col.near").alias("near")
    )
    found = sorted(sides.collect(), key=lambda r: r.pos)
    numbers = [r.pos for r in found if not r.flag]
    cuts: list[list[float]] = [[0.0] if r.low < r.high and r.flag else [] for r in found]
    if even:
        for f in numbers:
            cuts[f] = np.unique(np.linspace(found[f].low, found[f].high, bins + 1)[1:-1]).tolist()
    else:
        shares = [i / bins for i in range(1, bins)]
        for start in range(0, len(numbers), FEATURES_PER_PASS):
            own = numbers[start : start + FEATURES_PER_PASS]
            row = rows.agg(*[F.percentile_approx(F.col("x")[f], shares, ACCURACY).alias(f"q{f}") for f in own]).first()
            for f in own:
                cuts[f] = sorted({v for v in row[f"q{f}"] or [] if v < found[f].high})
    groups: list[list[int]] = []
    for r in found:
        joins = groups and r.flag and found[r.pos - 1].flag and len(groups[-1]) < 255 and r.near < groups[-1][0]
        groups[-1].append(r.pos) if joins else groups.append([r.pos])
    return Codes(cuts, groups, [bool(found[g[0]].flag) for g in groups])


# Cuts


@dataclass
class Rule:
    """What a cut is chosen by. ``subset`` features are drawn for a node, ``random`` draws a number's cut too."""

    l2: float = 0.0
    least: float = 1.0
    subset: int = 0
    random: bool = False


def cells(codes, slot, slots: int, stats, widths):
    """For each column the (slot * width + code) that occur, ascending, and the sums of the rows of ``stats`` there."""
    import numpy as np

    out = []
    for c, width in enumerate(widths):
        key, size = slot * width + codes[:, c], slots * width
        if size <= 8 * len(key) + 1024:
            found = np.flatnonzero(np.bincount(key, minlength=size))
            sums = np.stack([np.bincount(key, s, size)[found] for s in stats], 1)
        else:
            order = np.argsort(key)
            key = key[order]
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found, sums = key[starts], np.stack([np.add.reduceat(s[order], starts) for s in stats], 1)
        out.append((found, sums))
    return out


def choose(parts, totals, open_, codes: Codes, rule: Rule, random, gains: int):
    """Best cut of each open slot: (slot, column, code, gain, sums of the left side). ``totals`` and sums begin with the rows,
    the next ``gains`` entries are those that the gain is taken of. Equal gains: first column, first code.
    """
    import numpy as np

    score = lambda s: sum(s[:, 1 + k] ** 2 for k in range(gains)) / (s[:, 0] + rule.l2)
    offers = []
    for c, ((found, sums), width, own) in enumerate(zip(parts, codes.widths, codes.indicators)):
        if not len(found):
            continue
        at, code = found // width, found % width
        if own:
            left = totals[at] - sums
            keep = np.flatnonzero(open_[at] & (code > 0) & (left[:, 0] > 0.5))
        else:
            last = np.r_[at[1:] != at[:-1], True]
            first = np.r_[True, last[:-1]]
            run = np.cumsum(sums, 0)
            starts = np.flatnonzero(first)
            base = (run - sums)[starts]
            if rule.random:
                ends = np.flatnonzero(last)
                wide = open_[at[starts]] & (starts < ends)
                starts, ends, base = starts[wide], ends[wide], base[wide]
                drawn = code[starts] + (random.random_sample(len(starts)) * (code[ends] - code[starts])).astype(np.int64)
                at = at[starts]
                left = run[np.searchsorted(found, at * width + drawn, "right") - 1] - base
                code, keep = drawn, slice(None)
            else:
                keep = np.flatnonzero(open_[at] & ~last)
                left = run[keep] - np.repeat(base, np.diff(np.r_[starts, len(found)]), axis=0)[keep]
                at, code, keep = at[keep], code[keep], slice(None)
        offers.append((c, own, at[keep], code[keep], left[keep]))
    if rule.subset:
        offers = _drawn(offers, len(totals), sum(len(g) for g in codes.groups), rule.subset, random)
    whole, size = score(totals), totals.shape[1]
    best, column, value, lefts = np.full(len(totals), -np.inf), np.zeros(len(totals), int), np.zeros(len(totals), int), np.zeros((len(totals), size))
    for c, _, at, code, left in offers:
        right = totals[at] - left
        gain = score(left) + score(right) - whole[at]
        fit = np.flatnonzero((left[:, 0] >= rule.least) & (right[:, 0] >= rule.least) & (gain > best[at]))
        if len(fit):
            at, gain = at[fit], gain[fit]
            starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
            top = np.repeat(np.maximum.reduceat(gain, starts), np.diff(np.r_[starts, len(at)]))
            hit = np.flatnonzero(gain == top)
            hit = hit[np.r_[True, at[hit][1:] != at[hit][:-1]]]
            slot = at[hit]
            best[slot], column[slot], value[slot], lefts[slot] = gain[hit], c, code[fit[hit]], left[fit[hit]]
    slot = np.flatnonzero(best > -np.inf)
    return slot, column[slot], value[slot], best[slot], lefts[slot]


def _drawn(offers, slots: int, size: int, subset: int, random):
    """The offers of features drawn for each slot, without putting back, until one that differs is among them, ``subset`` at least.

    How many of the drawn ones differ is hypergeometric; which, is settled one by one: each is taken with the share of those
    still wanted among those still to come.
    """
    import numpy as np

    heads = [np.ones(len(at), bool) if own else np.r_[True, at[1:] != at[:-1]][: len(at)] for _, own, at, _, _ in offers]
    coming = sum((np.bincount(o[2][h], minlength=slots) for o, h in zip(offers, heads)), np.zeros(slots, np.int64))
    wanted = np.maximum(1, random.hypergeometric(coming, size - coming, min(subset, size)))
    wanted[coming == 0] = 0
    out = []
    for (c, own, at, code, left), head in zip(offers, heads):
        taken = np.zeros(len(at), bool)
        for group in [np.flatnonzero(code == v) for v in np.unique(code)] if own else [np.flatnonzero(head)]:
            slot = at[group]  # each once
            hit = random.random_sample(len(slot)) * coming[slot] < wanted[slot]
            coming[slot] -= 1
            wanted[slot[hit]] -= 1
            taken[group] = hit
        if not own:
            taken = taken[np.flatnonzero(head)][np.cumsum(head) - 1] if len(at) else taken
        out.append((c, own, at[taken], code[taken], left[taken]))
    return out


class Tree:
    """Arrays by node: column (-1 for an end), code, first of two neighbouring children, values."""

    def __init__(self, values: int = 1) -> None:
        self.column, self.code, self.child, self.value = [-1], [0], [0], [[0.0] * values]

    def split(self, node: int, column: int, code: int) -> int:
        left = len(self.column)
        self.column[node], self.code[node], self.child[node] = int(column), int(code), left
        self.column += [-1, -1]
        self.code += [0, 0]
        self.child += [0, 0]
        self.value += [self.value[node], self.value[node]]
        return left

    def arrays(self):
        import numpy as np

        return np.array(self.column, np.int16), np.array(self.code, np.uint8), np.array(self.child, np.int32), np.array(self.value, float)


def place(codes, indicators, arrays):
    """End of each row in a tree."""
    import numpy as np

    column, code, child = arrays[:3]
    own = np.array(indicators, bool)
    node, live = np.zeros(len(codes), np.int64), np.arange(len(codes))
    while True:
        live = live[column[node[live]] >= 0]
        if not len(live):
            return node
        at = node[live]
        c, v = column[at], codes[live, column[at]]
        node[live] = child[at] + np.where(own[c], v == code[at], v > code[at])


def _kept(used, slot, rows, part, within, means):
    return slot[used], rows[used], [s[used] for s in part], *(x if x is None else x[..., used] for x in (within, means))


def grow(codes, stats, within, layout: Codes, rule: Rule, depth: int, random, still: float):
    """A whole tree of the cells: (arrays, gains by feature). ``stats``: rows, then sums that values are means of; ``within``: squares of
    the distances from a cell's mean, None for classes. The child of an end is the place of its value.

    Nodes end when they are pure, at ``depth``, or when no feature differs. ``still``: spread of a row that counts as none.
    """
    import numpy as np

    size = sum(len(g) for g in layout.groups)
    gained = np.zeros(size)
    column, code, child, value = [], [], [], []
    part, rows, slot, slots, made, ends = list(stats), codes, np.zeros(len(codes), np.int64), 1, 1, 0
    means = None if within is None else stats[1:] / stats[0]
    own = np.array(layout.indicators, bool)
    for level in range(depth + 1):
        totals = np.stack([np.bincount(slot, s, slots) for s in part], 1)
        mean = totals[:, 1:] / totals[:, :1]
        if within is None:
            spread = totals[:, 0] - (totals[:, 1:] * mean).sum(1)
        else:
            spread = np.bincount(slot, within, slots)
            for k, m in enumerate(means):
                spread += np.bincount(slot, part[0] * (m - mean[slot, k]) ** 2, slots)
        open_ = (spread > still * totals[:, 0]) & (level < depth)
        col, cod, chi = np.full(slots, -1, np.int16), np.zeros(slots, np.uint8), np.zeros(slots, np.int32)
        if open_.any():
            names = np.flatnonzero(open_)
            used = np.flatnonzero(open_[slot])
            if len(used) < len(slot):
                slot, rows, part, within, means = _kept(used, slot, rows, part, within, means)
            slot = (np.cumsum(open_) - 1)[slot]
            at, c, v, gain, _ = choose(
                cells(rows, slot, len(names), part, layout.widths), totals[names], np.ones(len(names), bool), layout, rule, random, mean.shape[1]
            )
            gained += np.bincount(layout.features(c, v), np.maximum(gain, 0), size)
            col[names[at]], cod[names[at]] = c, v
            chi[names[at]] = made + 2 * np.arange(len(at))
            fresh, scol, scod = np.full(len(names), -1), np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
            fresh[at], scol[at], scod[at] = np.arange(len(at)), c, v
            kept = np.flatnonzero(fresh[slot] >= 0)
            if len(kept) < len(slot):
                slot, rows, part, within, means = _kept(kept, slot, rows, part, within, means)
            x, of = rows[np.arange(len(rows)), scol[slot]], scod[slot]
            right = np.where(own[scol[slot]], x == of, x > of)
            slot = 2 * fresh[slot] + right
            slots = 2 * len(at)
        else:
            slots = 0
        end = col < 0
        chi[end] = ends + np.arange(end.sum())
        ends += end.sum()
        column.append(col), code.append(cod), child.append(chi), value.append(mean[end])
        made += slots
        if not slots:
            break
    return tuple(np.concatenate(v) for v in (column, code, child, value)), gained


def byte_rows(codes):
    """The rows of a matrix of bytes as an Arrow column."""
    import numpy as np
    import pyarrow as pa

    ends = np.arange(len(codes) + 1, dtype=np.int32) * codes.shape[1]
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(codes.tobytes())])


def group_rows(rows: DataFrame, layout: Codes, by_label: bool) -> DataFrame:
    """(codes, y, n) of rows (x, y): those of the same codes and label as one, or those of the same codes with the mean of their labels."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([byte_rows(layout.encode(_array(batch.column(0)))), batch.column(1)], ["codes", "y"])

    coded = rows.select("x", "y").mapInArrow(run, "codes binary, y double")
    if by_label:
        return coded.groupBy("codes", "y").agg(F.count("*").alias("n"))
    return coded.groupBy("codes").agg(F.avg("y").alias("y"), F.count("*").alias("n"))


def pack_cells(spark, equal: DataFrame, width: int) -> tuple[DataFrame, int, int]:
    """Blocks of a written table (codes, y, n), and how many rows of it and cells they have: codes and first row of each cell, labels and numbers of
    its rows. The rows of a cell stand together, but for one of very many labels, whose rows are dealt like others.
    """
    most = equal.groupBy("codes").agg(F.count("*").alias("k")).agg(F.sum("k").alias("rows"), F.max("k").alias("most")).first()
    slices = -(-most.most // BLOCK_ROWS)

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        def block(parts):
            codes = np.frombuffer(b"".join(b"".join(p.column(0).to_pylist()) for p in parts), np.uint8)
            told, n = (np.concatenate([np.asarray(p.column(i), dtype=float) for p in parts]) for i in (1, 2))
            codes = codes.reshape(len(told), width)
            first = np.r_[True, (codes[1:] != codes[:-1]).any(1)]
            starts = np.flatnonzero(first)
            arrays = (codes[starts].tobytes(), starts.tobytes(), told.tobytes(), n.tobytes())
            names = ["codes", "starts", "told", "n", "cells"]
            return pa.RecordBatch.from_arrays([*[pa.array([a], pa.binary()) for a in arrays], pa.array([len(starts)], pa.int64())], names)

        parts, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                parts.append(batch)
                rows += batch.num_rows
                if rows >= BLOCK_ROWS:
                    yield block(parts)
                    parts, rows = [], 0
        if parts:
            yield block(parts)

    count = partitions(spark, most.rows, most.rows)
    dealt = equal.repartition(count, F.xxhash64("codes", F.pmod(F.xxhash64("y"), F.lit(slices)))).sortWithinPartitions("codes", "y")
    blocks = dealt.select("codes", "y", "n").mapInArrow(run, "codes binary, starts binary, told binary, n binary, cells long")
    packed = stage(blocks.withColumn("block", F.monotonically_increasing_id()), "cells")
    return packed, most.rows, packed.agg(F.sum("cells")).first()[0]


def pack_labels(equal: DataFrame, width: int) -> DataFrame:
    """(codes, told, n, cells) of batches of a table (codes, y, n): one row a batch."""

    def run(batches: Iterator) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                told, n = (np.asarray(batch.column(i), dtype=float).tobytes() for i in (1, 2))
                values = [pa.array([v], pa.binary()) for v in (b"".join(batch.column(0).to_pylist()), told, n)]
                yield pa.RecordBatch.from_arrays([*values, pa.array([batch.num_rows], pa.int64())], ["codes", "told", "n", "cells"])

    return equal.select("codes", "y", "n").mapInArrow(run, "codes binary, told binary, n binary, cells long")


def unpack(codes: bytes, rows: int, width: int):
    import numpy as np

    return np.frombuffer(codes, np.uint8).reshape(rows, width)


def partitions(spark, rows: int, blocks: int) -> int:
    """Into how many partitions blocks are dealt: all cores have work, and a task's share does not grow with the rows."""
    return max(1, min(blocks, max(spark.sparkContext.defaultParallelism, -(-rows // PARTITION_ROWS))))


def merged(a, b):
    a += b
    return a


# Forests


def _blob(arrays) -> list[bytes]:
    return [a.tobytes() for a in arrays]


def _weights(n, seed: int, tree: int, block: int, bootstrap: bool):
    """How often the rows of a block are in a tree's sample; ``n`` says how many equal rows each stands for."""
    import numpy as np

    return np.random.RandomState([seed, tree, block & 0xFFFFFFFF, block >> 32]).poisson(n).astype(float) if bootstrap else n


class Forest(Estimator, HasFeaturesCol, HasLabelCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Trees on all rows or on rows drawn with putting back; ``classes`` 0 is regression, whose values are means of the labels.

    A number has up to ``bins`` bins. ``subset`` features are drawn for every node (0: all). With ``random`` the cut of a number
    is drawn too, between the node's least and greatest value.
    """

    trees = Param(Params._dummy(), "trees", "trees", TypeConverters.toInt)
    subset = Param(Params._dummy(), "subset", "features drawn for a node, 0 for all", TypeConverters.toInt)
    bootstrap = Param(Params._dummy(), "bootstrap", "whether rows are drawn", TypeConverters.toBoolean)
    random = Param(Params._dummy(), "random", "whether cuts are drawn", TypeConverters.toBoolean)
    depth = Param(Params._dummy(), "depth", "levels at most", TypeConverters.toInt)
    classes = Param(Params._dummy(), "classes", "number of classes, 0 for regression", TypeConverters.toInt)
    bins = Param(Params._dummy(), "bins", "bins of a number, 256 at most", TypeConverters.toInt)
    randomSeed = Param(Params._dummy(), "randomSeed", "seed of all draws", TypeConverters.toInt)

    @keyword_only
    def __init__(self, trees=1, subset=0, bootstrap=False, random=False, depth=30, classes=0, bins=255, randomSeed=42):
        super().__init__()
        self._setDefault(
            featuresCol="features", labelCol="label", predictionCol="prediction", trees=1, subset=0, bootstrap=False, random=False, depth=30, classes=0,
            bins=255, randomSeed=42,
        )
        self._set(**self._input_kwargs)

    def _fit(self, df: DataFrame) -> "ForestModel":
        import numpy as np

        spark = df.sparkSession
        count, depth, classes, seed = (self.getOrDefault(p) for p in (self.trees, self.depth, self.classes, self.randomSeed))
        bootstrap = self.getOrDefault(self.bootstrap)
        rule = Rule(subset=self.getOrDefault(self.subset), random=self.getOrDefault(self.random))
        own = df.select(vector_to_array(self.getFeaturesCol()).alias("x"), F.col(self.getLabelCol()).cast("double").alias("y"))
        facts = own.agg(F.avg("y").alias("mean"), F.var_pop("y").alias("spread"), F.count("*").alias("rows")).first()
        if not facts.rows:
            raise ValueError("no training rows")
        layout = fit_codes(own, min(self.getOrDefault(self.bins), 256), rule.random)
        width, outputs = len(layout.groups), classes or 1
        base, still = (0.0, 1e-12) if classes else (facts.mean, 1e-14 * (facts.spread or 0.0))
        packed, rows, size = pack_cells(spark, stage(group_rows(own, layout, True), "forest-rows"), width)
        columns = ["block", "codes", "starts", "told", "n"]
        dealt = packed.select(*columns).repartition(partitions(spark, rows, packed.count()), F.xxhash64("block"))

        def samples(codes: bytes, starts: bytes, told: bytes, n: bytes, trees_, block: int):
            """(tree, codes, stats) of a block's cells for each tree: rows, sums of the goals, and squares of the distances from the cell's mean."""
            starts, y, n = np.frombuffer(starts, np.int64), np.frombuffer(told), np.frombuffer(n)
            codes, goal = unpack(codes, len(starts), width), None if classes else y - base
            cell, last = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(y)])), None
            for t in trees_:
                if bootstrap or last is None:
                    w = _weights(n, seed, t, block, bootstrap)
                    whole = np.add.reduceat(w, starts)
                    kept_ = np.flatnonzero(whole > 0)
                    if classes:
                        stats = np.stack([whole] + [np.add.reduceat(np.where(y == k, w, 0.0), starts) for k in range(classes)])
                    else:
                        sums = np.add.reduceat(w * goal, starts)
                        apart = goal - (sums / np.maximum(whole, 1.0))[cell]
                        stats = np.stack([whole, sums, np.add.reduceat(w * apart**2, starts)])
                    last = (codes, stats) if len(kept_) == len(codes) else (codes[kept_], stats[:, kept_])
                yield t, *last

        local = max(1, min(LOCAL_ROWS, LOCAL_BYTES // (8 * max(1, width) * (outputs + 2))))
        tops = [Tree(outputs) for _ in range(count)]
        gained = np.zeros((count, sum(len(g) for g in layout.groups)))
        ended: dict[tuple[int, int], object] = {}
        asked = [(t, 0) for t in range(count)] if size > local and width else []
        if asked:
            kept = dealt.rdd.map(tuple).persist(StorageLevel.MEMORY_AND_DISK)
        level, offsets = 0, np.r_[0, np.cumsum(layout.widths)].astype(int)
        while asked and level < depth:
            arrays, following = {t: tops[t].arrays() for t in {t for t, _ in asked}}, []
            step = max(1, PASS_CELLS // (int(offsets[-1]) * (outputs + 2)))
            for start in range(0, len(asked), step):
                some = asked[start : start + step]
                wanted: dict[int, list[int]] = {}
                for t, node in some:
                    wanted.setdefault(t, []).append(node)

                def add(part, wanted=wanted, arrays={t: arrays[t] for t in wanted}, size=len(some)):
                    sums = np.zeros((size, int(offsets[-1]), outputs + 2))  # the last: cells
                    for block, codes, starts, told, n in part:
                        first = 0
                        for t, codes_, stats in samples(codes, starts, told, n, wanted, block):
                            nodes = wanted[t]
                            slots = np.full(len(arrays[t][0]), -1)
                            slots[nodes] = np.arange(len(nodes))
                            at = slots[place(codes_, layout.indicators, arrays[t])]
                            used = np.flatnonzero(at >= 0)
                            spot, stats_ = at[used], [*stats[: outputs + 1, used], None]
                            for c, wide in enumerate(layout.widths):
                                key = spot * wide + codes_[used, c]
                                for k, s in enumerate(stats_):
                                    sums[first : first + len(nodes), offsets[c] : offsets[c + 1], k] += np.bincount(key, s, len(nodes) * wide).reshape(-1, wide)
                            first += len(nodes)
                    yield sums

                sums = kept.mapPartitions(add).treeReduce(merged, 3)
                order = [(t, node) for t, nodes in wanted.items() for node in nodes]
                totals = sums[:, offsets[0] : offsets[1]].sum(1)
                parts = []
                for c, wide in enumerate(layout.widths):
                    flat = sums[:, offsets[c] : offsets[c + 1]].reshape(-1, outputs + 2)
                    found = np.flatnonzero(flat[:, 0])
                    parts.append((found, flat[found]))
                open_ = totals[:, 0] > 0
                if classes:
                    open_ &= totals[:, 1 : outputs + 1].max(1) < totals[:, 0]
                random = np.random.RandomState([seed, level, start, 1])
                best = {int(s): (int(c), int(v), g, left) for s, c, v, g, left in zip(*choose(parts, totals, open_, layout, rule, random, outputs))}
                for s, (t, node) in enumerate(order):
                    if s not in best or (not classes and best[s][2] <= 0):
                        ended[t, node] = totals[s, 1 : outputs + 1] / max(totals[s, 0], 1e-300)
                        continue
                    c, v, gain, left = best[s]
                    gained[t, int(layout.features(np.array([c]), np.array([v]))[0])] += max(gain, 0.0)
                    child = tops[t].split(node, c, v)
                    for place_, side in ((child, left), (child + 1, totals[s] - left)):
                        if level + 1 >= depth:
                            ended[t, place_] = side[1 : outputs + 1] / side[0]
                        elif side[-1] > local:
                            following.append((t, place_))
            asked, level = following, level + 1
        if level:
            kept.unpersist()
        folder = scratch_path(spark, "forest")
        schema = "tree int, node int, column binary, code binary, child binary, value binary, gained array<double>"
        arrays, depths = [t.arrays() for t in tops], [_depths(t) for t in tops]
        done = {t: {node for tree, node in ended if tree == t} for t in range(count)}

        def deal(group: list[int]):
            def run(batches: Iterator) -> Iterator:
                import pyarrow as pa

                for batch in batches:
                    for block, *packs in zip(*(batch.column(i).to_pylist() for i in range(5))):
                        for t, codes, stats in samples(*packs, group, block):
                            at, out = place(codes, layout.indicators, arrays[t]), []
                            order = at.argsort(kind="stable")
                            for here in np.split(order, np.flatnonzero(np.diff(at[order])) + 1):
                                if len(here) and (node := int(at[here[0]])) not in done[t]:
                                    out.append((t, node, block, codes[here].tobytes(), np.ascontiguousarray(stats[sent_stats, here[:, None]]).tobytes()))
                            if out:
                                yield pa.RecordBatch.from_arrays(
                                    [pa.array(v, ty) for v, ty in zip(zip(*out), (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()))],
                                    ["tree", "node", "block", "codes", "stats"],
                                )

            return run

        def finish(key, table):
            import pyarrow as pa

            t, node = (k.as_py() for k in key)
            table = table.sort_by("block")
            stats = np.frombuffer(b"".join(table["stats"].to_pylist())).reshape(-1, outputs if classes else 3).T
            codes = np.frombuffer(b"".join(table["codes"].to_pylist()), np.uint8).reshape(stats.shape[1], width)
            if classes:
                stats, within = np.vstack([stats.sum(0), stats]), None
            else:
                stats, within = stats[:2], stats[2]
            random = np.random.RandomState([seed, t, node, 2])
            found, gains = grow(codes, stats, within, layout, rule, depth - depths[t][node], random, still)
            columns = [[t], [node], *[[b] for b in _blob(found)], [gains.tolist()]]
            types = [pa.int32(), pa.int32(), *[pa.binary()] * 4, pa.list_(pa.float64())]
            return pa.table([pa.array(c, ty) for c, ty in zip(columns, types)], names=["tree", "node", "column", "code", "child", "value", "gained"])

        sent_stats = list(range(1, classes + 1)) if classes else [0, 1, 2]
        each = max(1, DEALT_ROWS // size)
        for start in range(0, count, each):
            group = list(range(start, min(count, start + each)))
            parts = max(min(len(group) * 4, spark.sparkContext.defaultParallelism * 4), -(-size * len(group) // PARTITION_ROWS))
            sent = dealt.mapInArrow(deal(group), "tree int, node int, block long, codes binary, stats binary")
            spread = sent.repartition(parts, "tree", "node")
            spread.groupBy("tree", "node").applyInArrow(finish, schema).write.mode("append").parquet(folder)
        if ended:
            ends = [(t, n, *map(bytearray, _blob((*Tree(outputs).arrays()[:3], np.asarray(v, float)[None]))), [0.0] * gained.shape[1]) for (t, n), v in ended.items()]
            spark.createDataFrame(ends, schema).write.mode("append").parquet(folder)
        gains = spark.read.schema(schema).parquet(folder).select("tree", F.posexplode("gained")).groupBy("tree", "pos").agg(F.sum("col").alias("g")).where("g > 0")
        for r in gains.collect():
            gained[r.tree, r.pos] += r.g
        shares = gained / np.maximum(gained.sum(1, keepdims=True), 1e-300)
        total = shares.sum()
        document = json.dumps({
            "cuts": layout.cuts, "groups": layout.groups, "indicators": layout.indicators, "base": base, "classes": classes, "cells": size,
            "tops": [[t.column, t.code, t.child] for t in tops], "importances": (shares.sum(0) / (total or 1.0)).tolist(),
        })
        return ForestModel(document=document, folder=folder, featuresCol=self.getFeaturesCol(), predictionCol=self.getPredictionCol())


def _depths(tree: Tree) -> list[int]:
    out = [0] * len(tree.column)
    for node, column in enumerate(tree.column):
        if column >= 0:
            out[tree.child[node]] = out[tree.child[node] + 1] = out[node] + 1
    return out


class _ForestWriter(DefaultParamsWriter):
    def saveImpl(self, path: str) -> None:
        super().saveImpl(path)
        self.sparkSession.read.parquet(self.instance.getOrDefault("folder")).write.parquet(f"{path}/subtrees")


class _ForestReader(DefaultParamsReader):
    def load(self, path: str):
        return super().load(path)._set(folder=f"{path}/subtrees")


class ForestModel(Transformer, HasFeaturesCol, HasPredictionCol, DefaultParamsReadable, DefaultParamsWritable):
    """Tops of the trees in the document, subtrees in a table. Adds prediction, and probabilities for classes."""

    document = Param(Params._dummy(), "document", "codes and tops", TypeConverters.toString)
    folder = Param(Params._dummy(), "folder", "table of subtrees", TypeConverters.toString)

    @keyword_only
    def __init__(self, document=None, folder=None, featuresCol="features", predictionCol="prediction"):
        super().__init__()
        self._setDefault(featuresCol="features", predictionCol="prediction")
        self._set(**self._input_kwargs)

    def write(self):
        return _ForestWriter(self)

    @classmethod
    def read(cls):
        return _ForestReader(cls)

    @property
    def featureImportances(self):
        """Mean of the trees' shares of the impurity that each feature's cuts take away."""
        from pyspark.ml.linalg import Vectors

        return Vectors.dense(json.loads(self.getOrDefault(self.document))["importances"])

    def _transform(self, df: DataFrame) -> DataFrame:
        import numpy as np

        spark, d = df.sparkSession, json.loads(self.getOrDefault(self.document))
        layout, outputs, base = Codes(d["cuts"], d["groups"], d["indicators"]), d["classes"] or 1, d["base"]
        width, trees = len(layout.groups), len(d["tops"])
        tops = [(np.array(a, np.int16), np.array(b, np.uint8), np.array(c, np.int32)) for a, b, c in d["tops"]]

        @F.pandas_udf("binary")
        def coded(vectors):
            import pandas as pd

            if not len(vectors):
                return pd.Series([], dtype=object)
            return pd.Series(byte_rows(layout.encode(np.stack(vectors.to_numpy()).astype(float))).to_pylist())

        def pack(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(batch.column(0).to_pylist())], pa.binary()), pa.array([batch.num_rows], pa.int64())], ["codes", "cells"])

        rows = stage(df.withColumn("__codes", coded(vector_to_array(self.getFeaturesCol()))), "to-score")
        cells_ = rows.select("__codes").distinct().repartition(spark.sparkContext.defaultParallelism, F.xxhash64("__codes"))
        packed = stage(cells_.mapInArrow(pack, "codes binary, cells long").withColumn("block", F.monotonically_increasing_id()), "score-cells")
        count = packed.agg(F.sum("cells")).first()[0] or 0
        parts = 1 + count // (4 * d["cells"])  # cells of a subtree in one group are bounded by those it was grown from

        def deal(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                for codes, size, block in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    codes = unpack(codes, size, width)
                    for t, top in enumerate(tops):
                        at, out = place(codes, layout.indicators, top), []
                        for node in np.unique(at):
                            here = np.flatnonzero(at == node)
                            out.append((block, t, int(node), (block + (block >> 33)) % parts, here.astype(np.int32).tobytes(), codes[here].tobytes()))
                        types = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                        yield pa.RecordBatch.from_arrays([pa.array(v, ty) for v, ty in zip(zip(*out), types)], ["block", "tree", "node", "part", "rows", "codes"])

        def score(asked, known):
            import pyarrow as pa

            out = []
            if asked.num_rows:
                row = known.to_pylist()[0]
                tree = tuple(np.frombuffer(row[n], ty) for n, ty in (("column", np.int16), ("code", np.uint8), ("child", np.int32)))
                value = np.frombuffer(row["value"]).reshape(-1, outputs)
                for block, here, codes in zip(*(asked[n].to_pylist() for n in ("block", "rows", "codes"))):
                    n = len(here) // 4
                    codes = np.frombuffer(codes, np.uint8).reshape(n, width)
                    out.append((block, here, value[tree[2][place(codes, layout.indicators, tree)]].tobytes()))
            columns = list(zip(*out)) if out else [[], [], []]
            return pa.table([pa.array(list(c), ty) for c, ty in zip(columns, (pa.int64(), pa.binary(), pa.binary()))], names=["block", "rows", "values"])

        def total(found, asked):
            import pyarrow as pa

            codes, size = (asked[n].to_pylist()[0] for n in ("codes", "cells"))
            known, sums = unpack(codes, size, width), np.zeros((size, outputs))
            for here, values in zip(*(found[n].to_pylist() for n in ("rows", "values"))):
                sums[np.frombuffer(here, np.int32)] += np.frombuffer(values).reshape(-1, outputs)
            return pa.table([byte_rows(known), pa.array(list(sums / trees + base), pa.list_(pa.float64()))], names=["__codes", "__values"])

        parts_out = max(spark.sparkContext.defaultParallelism, -(-count * trees // PARTITION_ROWS))
        sent = packed.mapInArrow(deal, "block long, tree int, node int, part int, rows binary, codes binary").repartition(parts_out, "tree", "node", "part")
        subtrees = spark.read.parquet(self.getOrDefault(self.folder)).drop("gained").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        key = ["tree", "node", "part"]
        met = sent.groupBy(*key).cogroup(subtrees.repartition(parts_out, *key).groupBy(*key)).applyInArrow(score, "block long, rows binary, values binary")
        sums = met.groupBy("block").cogroup(packed.groupBy("block")).applyInArrow(total, "__codes binary, __values array<double>")
        out = rows.join(sums, "__codes").drop("__codes")
        if not d["classes"]:
            return out.withColumn(self.getPredictionCol(), F.col("__values")[0]).drop("__values")
        best = (F.array_position("__values", F.array_max("__values")) - 1).cast("double")
        return out.withColumn("probability", array_to_vector("__values")).withColumn(self.getPredictionCol(), best).drop("__values")
