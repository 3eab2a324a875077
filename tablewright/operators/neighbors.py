"""Exact k nearest neighbours as blocked equi-joins.

Equal vectors are asked once, and of equal training vectors only the k first ids can be neighbours. Training rows
belong to the cells of a k-d tree, whose number follows that of the rows. A test row first meets its own cell; the
distance of the k-th row there tells which other cells, by their bounding boxes, can hold a nearer one. A crowded cell
is cut into blocks of bounded size on both sides, and a block returns its k best per test row, never its pairs.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tables import spread_by
from ..session import stage

PIVOTS = 128  # cells, at least, in few dimensions
BLOCK_ROWS = 2048  # training rows of a block, at least
WIDE_ROWS = 16_384  # in many dimensions, where nearly all blocks are met: fewer of them send rows less often and return fewer
WIDE_NUMBERS = 1_500_000  # in their vectors, at most
ASKED_BLOCK_ROWS = 4096
CELL_ROWS = 512  # in few dimensions, where boxes exclude most cells
FEW = 8
TREE_ROWS = 16  # for each cell, that tell where the tree cuts
TREE_NUMBERS = 4_000_000  # in these rows, at most
PRODUCT_ROWS = 2048  # training rows of one product
ASKED_ROWS = 512  # test rows of one product


def _tree(x, cells: int):
    """Arrays of a k-d tree: dimension (-1 for a cell), cut, children, and the number of a cell.

    Cuts halve the widest dimension. They only deal rows to cells, so any rows ``x`` give exact neighbours.
    """
    import numpy as np

    dims, cuts, children, number = [], [], [], []
    leaves = 0

    def grow(own, wanted: int) -> int:
        nonlocal leaves
        node = len(dims)
        dims.append(-1), cuts.append(0.0), children.append((node, node)), number.append(-1)
        span = np.ptp(own, axis=0) if wanted > 1 and len(own) > 1 else np.zeros(1)
        if span.max() > 0:
            d = int(span.argmax())
            values = np.sort(own[:, d])
            cut = values[(len(values) - 1) // 2]
            cut = cut if cut < values[-1] else values[values < cut].max()
            left = own[:, d] <= cut
            dims[node], cuts[node] = d, float(cut)
            children[node] = (grow(own[left], wanted // 2), grow(own[~left], wanted - wanted // 2))
        else:
            number[node], leaves = leaves, leaves + 1
        return node

    grow(x, cells)
    return np.array(dims), np.array(cuts), np.array(children), np.array(number, dtype=np.int32)


def _cell(tree):
    """Column function vector -> its cell."""
    dims, cuts, children, number = tree

    @F.pandas_udf("int")
    def cell(vectors):
        import numpy as np
        import pandas as pd

        out = [np.zeros(0, np.int32)]
        for start in range(0, len(vectors), 4096):
            x = np.stack(vectors.iloc[start : start + 4096].to_numpy()).astype(float)
            node, rows = np.zeros(len(x), np.int64), np.arange(len(x))
            while (inner := dims[node] >= 0).any():
                right = x[rows, np.maximum(dims[node], 0)] > cuts[node]
                node = np.where(inner, children[node, right.astype(int)], node)
            out.append(number[node])
        return pd.Series(np.concatenate(out))

    return cell


def _others(cells, low, high):
    """Column function (own cell, vector, distance) -> other cells whose boxes are no farther than the distance."""

    @F.pandas_udf("array<int>")
    def others(own, vectors, reach):
        import numpy as np
        import pandas as pd

        out = [None] * len(own)
        own, reach = own.to_numpy(), reach.to_numpy() * (1 + 1e-9) + 1e-12
        order = own.argsort(kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(own[order])) + 1):
            for part in (rows[i : i + 256] for i in range(0, len(rows), 256)):
                x = np.stack(vectors.iloc[part].to_numpy()).astype(float)
                apart = np.maximum(np.maximum(low - x.max(0), x.min(0) - high), 0)  # of boxes
                near = np.flatnonzero((np.sqrt((apart**2).sum(1)) <= reach[part].max()) & (cells != own[part[0]]))
                step = max(1, 4_000_000 // max(1, low[near].size))
                for start in range(0, len(part), step):
                    q = x[start : start + step, None, :]
                    gap = np.sqrt((np.maximum(np.maximum(low[near] - q, q - high[near]), 0) ** 2).sum(2))
                    for i, row in zip(part[start : start + step], gap):
                        out[i] = cells[near[row <= reach[i]]]
        return pd.Series(out)

    return others


def _candidates(x, q, k):
    """(row, place) of all training rows ``x`` that can be among the k nearest of rows ``q``, and some more.

    Squared distances come from matrix products in single precision, on rows moved to their middle. A row stays if it is no farther than the
    k-th so far by more than twice the error that these products can have; of those, exact distances decide.
    """
    import numpy as np

    if not (np.isfinite(x).all() and np.isfinite(q).all()):
        return np.divmod(np.arange(len(q) * len(x)), len(x))
    middle = x.mean(0)
    x, q = x - middle, q - middle
    scale = max(float(np.abs(x).max(initial=0)), float(np.abs(q).max(initial=0)), 1e-300)
    x, q = (x / scale).astype(np.float32), (q / scale).astype(np.float32)
    of_x, of_q = (x.astype(float) ** 2).sum(1), (q.astype(float) ** 2).sum(1)
    # Rounding of the rows, of the products and of the sums.
    slack = (2.0 * (x.shape[1] + 16) * 2.0**-24 * (np.sqrt(of_q) + np.sqrt(of_x.max(initial=0))) ** 2 + 1e-30).astype(np.float32)
    # The test row's own square is the same for all and is left out.
    x, q = np.hstack([-2.0 * x, of_x[:, None].astype(np.float32)], dtype=np.float32), np.hstack([q, np.ones((len(q), 1), np.float32)])
    step = max(k, PRODUCT_ROWS)
    products = np.empty((len(q), step), np.float32)
    best, rows, picks, values = np.full((len(q), k), np.inf, np.float32), [], [], []
    for start in range(0, len(x), step):
        d = np.matmul(q, x[start : start + step].T, out=products if start + step <= len(x) else None)
        if not start:
            near = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k]
            best[:, : near.shape[1]] = near
        hit = np.flatnonzero(d <= (best.max(1) + 2.0 * slack)[:, None])
        row, pick = np.divmod(hit, d.shape[1])
        value = d.ravel()[hit]
        rows.append(row), picks.append(start + pick), values.append(value)
        if start and len(row):
            order = np.lexsort((value, row))
            first = np.arange(len(row)) - np.searchsorted(row[order], row[order])
            order, first = order[first < k], first[first < k]
            more = np.full((len(q), k), np.inf, np.float32)
            more[row[order], first] = value[order]
            best = np.sort(np.hstack([best, more]), axis=1)[:, :k]
    row, pick, value = (np.concatenate(v) if v else np.zeros(0, int) for v in (rows, picks, values))
    kept = value <= (best.max(1) + 2.0 * slack)[row]
    return row[kept], pick[kept]


def _block_neighbours(k):
    def best(left, right):
        import numpy as np
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"test_id": [], "train_id": [], "label": [], "distance": []})
        x = np.stack(left["vector"].to_numpy()).astype(float)
        q = np.stack(right["vector"].to_numpy()).astype(float)
        order = left["train_id"].to_numpy().argsort(kind="stable")
        x, ids, labels = x[order], left["train_id"].to_numpy()[order], left["label"].to_numpy()[order]
        rows, picks, distances = [], [], []
        for start in range(0, len(q), ASKED_ROWS):
            row, pick = _candidates(x, q[start : start + ASKED_ROWS], k)
            row += start
            step = max(1, 4_000_000 // max(1, x.shape[1]))
            d = np.concatenate([np.sqrt(((q[row[i : i + step]] - x[pick[i : i + step]]) ** 2).sum(axis=1)) for i in range(0, len(row), step)])
            by = np.lexsort((pick, d, row))  # equal distances stay in id order
            row, pick, d = row[by], pick[by], d[by]
            first = np.arange(len(row)) - np.searchsorted(row, row) < k
            rows.append(row[first]), picks.append(pick[first]), distances.append(d[first])
        rows, picks = np.concatenate(rows), np.concatenate(picks)
        return pd.DataFrame(
            {
                "test_id": right["test_id"].to_numpy()[rows], "train_id": ids[picks], "label": labels[picks],
                "distance": np.concatenate(distances),
            }
        )

    return best


def _in_blocks(known: DataFrame, asked: DataFrame, k: int, block_rows: int, types: dict[str, str]) -> DataFrame:
    """The k best of each cell's block for every row of ``asked`` (test_id, vector, cell)."""
    sizes = lambda rows, most, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / most).cast("int").alias(name))
    blocks = stage(sizes(known, block_rows, "of_train").join(sizes(asked, min(block_rows, ASKED_BLOCK_ROWS), "of_test"), "cell"), "neighbour-blocks")
    dealt = lambda rows, own, name, mine, other, theirs: rows.join(blocks, "cell").select(
        *rows.columns, F.pmod(F.hash(own), mine).alias(name), F.explode(F.sequence(F.lit(0), F.col(theirs) - 1)).alias(other)
    )
    left = dealt(known, "train_id", "t", "of_train", "s", "of_test")
    right = dealt(asked, "test_id", "s", "of_test", "t", "of_train")
    block = ["cell", "t", "s"]
    return spread_by(left, block).groupBy(*block).cogroup(spread_by(right, block).groupBy(*block)).applyInPandas(
        _block_neighbours(k), f"test_id long, train_id {types['id']}, label {types['label']}, distance double"
    )


def _nearest(near: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("test_id").orderBy("distance", "train_id"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def wide_block(size: int) -> int:
    """Training rows of a block of vectors of ``size`` numbers."""
    return BLOCK_ROWS if size <= FEW else max(BLOCK_ROWS, min(WIDE_ROWS, WIDE_NUMBERS // size))


def nearest_neighbours(train: DataFrame, test: DataFrame, k: int = 5, pivots: int | None = None, block_rows: int | None = None) -> DataFrame:
    """(test_id, train_id, label, distance, place): the k nearest training rows, ties by train_id.

    ``train`` has (id, vector, label), ``test`` has (id, vector); vectors are arrays. ``pivots`` is the least number of cells.
    """
    import numpy as np

    copy = F.row_number().over(Window.partitionBy("vector").orderBy("id"))
    known = stage(train.select("id", "vector", "label").withColumn("copy", copy).where(F.col("copy") <= k).drop("copy"), "neighbour-rows")
    rows = known.count()
    if not rows:
        raise ValueError("no training rows")
    size = len(known.select("vector").first()[0])
    block_rows = block_rows or wide_block(size)
    pivots = pivots or (PIVOTS if size <= FEW else 1)
    cells = max(pivots, math.ceil(rows / (min(CELL_ROWS, block_rows) if size <= FEW else block_rows)))
    wanted = min(TREE_ROWS * cells, TREE_NUMBERS // max(1, size))
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(max(1, rows // max(1, wanted)))) == 0).select("vector").toPandas()["vector"]
    tree = _tree(np.stack(chosen.to_numpy()).astype(float) if len(chosen) else np.zeros((0, size)), cells)
    known = stage(known.select(F.col("id").alias("train_id"), "vector", "label", _cell(tree)("vector").alias("cell")), "neighbour-cells")
    at = [F.col("vector")[i] for i in range(size)]
    boxes = known.groupBy("cell").agg(F.array(*map(F.min, at)).alias("low"), F.array(*map(F.max, at)).alias("high")).collect()  # a row a cell
    numbers = np.array([r["cell"] for r in boxes], dtype=np.int32)
    low, high = (np.array([r[c] for r in boxes], dtype=float).reshape(len(boxes), size) for c in ("low", "high"))
    asked = stage(test.select("vector").distinct().select(F.monotonically_increasing_id().alias("test_id"), "vector"), "neighbour-asked")
    asked = spread_by(asked.withColumn("cell", _cell(tree)("vector")), ["cell"])
    asked = stage(asked.sortWithinPartitions("cell"), "neighbour-asked")
    types = {c: train.schema[c].dataType.simpleString() for c in ("id", "label")}
    own = stage(_nearest(_in_blocks(known, asked, k, block_rows, types), k).drop("place"), "neighbours-own")
    reach = own.groupBy("test_id").agg(F.count("*").alias("n"), F.max("distance").alias("reach"))
    far = F.when(F.col("n") >= k, F.col("reach")).otherwise(F.lit(math.inf))
    told = asked.join(reach, "test_id", "left").select("test_id", "vector", "cell", F.coalesce(far, F.lit(math.inf)).alias("reach"))
    # Sorted again, as rows of one cell share the test of the boxes.
    told = spread_by(told, ["cell"]).sortWithinPartitions("cell")
    more = told.select("test_id", "vector", F.explode(_others(numbers, low, high)("cell", "vector", "reach")).alias("cell"))
    near = _nearest(own.unionByName(_in_blocks(known, stage(more, "neighbour-more"), k, block_rows, types)), k)
    named = near.join(asked.select("test_id", "vector"), "test_id").drop("test_id")
    return test.select(F.col("id").alias("test_id"), "vector").join(named, "vector").select("test_id", "train_id", "label", "distance", "place")


def knn_classify(train: DataFrame, test: DataFrame, k: int = 5, exact: bool = True, **options) -> DataFrame:
    """(id, label, votes): the most frequent label among the k nearest, the smallest label on ties.

    Without ``exact`` neighbours come from the index of ``vector_index``.
    """
    from .vector_index import index_neighbours

    near = (nearest_neighbours if exact else index_neighbours)(train, test, k, **options)
    votes = near.groupBy("test_id", "label").agg(F.count(F.lit(1)).alias("n"))
    return votes.groupBy(F.col("test_id").alias("id")).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label"), F.max("n").alias("votes")
    )
