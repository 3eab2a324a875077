"""Approximate k nearest neighbours: cells of a product of two codebooks, several probes a row, exact distances inside.

A vector is cut in two halves, and each half has a codebook of centres, fitted on a bounded sample. A cell is a pair of
centres, so few centres give many cells, and a cell holds about ``CELL_ROWS`` training rows however many there are. A test row
visits the cells whose centres are nearest to its halves, and is compared exactly with the rows of these: about ``CANDIDATES`` of
them where that is enough. Whether it is, is measured: the true neighbours of up to ``TRIALS`` test rows are looked for, and as many
cells are visited as hold ``WANTED`` of them. Rows without clusters need most cells; cells are then made larger, so that a test row
is not sent to very many. Cells are met by equi-joins, and a crowded one is cut in blocks on both sides.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.tables import spread_by
from ..session import stage
from .neighbors import _block_neighbours, nearest_neighbours, wide_block

SAMPLE = 50_000  # training rows that codebooks are fitted on, at most
CENTRES = 4_096  # in a codebook, at most
CELL_ROWS = 64
CANDIDATES = 1_280
QUERY_ROWS = 4_096  # test rows of a cell in one block
TRIALS = 200  # test rows whose true neighbours tell how many cells are visited
WANTED = 0.98  # share of these neighbours that the visited cells hold
MOST_PROBES = 64  # above it cells are made larger
ROUNDS = 12
SPLITS = 16


def codebook_rows(train: DataFrame, seed: int = 42):
    """Matrix of at most ``SAMPLE`` training vectors, on which codebooks are fitted."""
    import numpy as np

    sample = train.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(SAMPLE).select("vector").collect()
    if not sample:
        raise ValueError("no training rows")
    return np.array([r["vector"] for r in sample], dtype=float)


def fit_codebooks(x, rows: int, seed: int = 42, cell_rows: int = CELL_ROWS):
    """Two arrays of centres by Lloyd's rounds on the matrix ``x``, for cells of about ``cell_rows`` of ``rows`` rows."""
    import numpy as np

    count = min(CENTRES, max(1, math.isqrt(max(1, rows // cell_rows))), len(x))
    half = max(1, x.shape[1] // 2)
    random, books = np.random.RandomState(seed), []
    for part in (x[:, :half], x[:, half:]):
        centres = part[random.choice(len(part), count, replace=False)].copy()
        for _ in range(ROUNDS):
            nearest = np.concatenate([_squares(part[i : i + 1024], centres).argmin(1) for i in range(0, len(part), 1024)])
            members = np.bincount(nearest, minlength=count)
            for d in range(part.shape[1]):
                sums = np.bincount(nearest, part[:, d], count)
                centres[:, d] = np.where(members > 0, sums / np.maximum(members, 1), centres[:, d])
        books.append(centres)
    return books


def _squares(x, centres):
    """Squared distances of all rows to all centres; 0 for halves without dimensions."""
    return (x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)


def _cells(books, probes: int):
    """Column function vector -> its ``probes`` nearest cells, the nearest first."""
    half, count = books[0].shape[1], len(books[0])

    @F.pandas_udf("array<long>")
    def cells(vectors):
        import numpy as np
        import pandas as pd

        out, most = [], min(count, probes)  # of each half only the nearest centres can be in one of the first cells
        for start in range(0, len(vectors), 256):
            x = np.stack(vectors.iloc[start : start + 256].to_numpy()).astype(float)
            near = []
            for part, centres in ((x[:, :half], books[0]), (x[:, half:], books[1])):
                d = _squares(part, centres)
                order = d.argsort(axis=1, kind="stable")[:, :most]
                near.append((order, np.take_along_axis(d, order, axis=1)))
            (a, da), (b, db) = near
            total = (da[:, :, None] + db[:, None, :]).reshape(len(x), -1)
            cell = (a[:, :, None].astype(np.int64) * count + b[:, None, :]).reshape(len(x), -1)
            first = total.argsort(axis=1, kind="stable")[:, :probes]
            out += list(np.take_along_axis(cell, first, axis=1))
        return pd.Series(out)

    return cells


def index_neighbours(train: DataFrame, test: DataFrame, k: int = 5, candidates: int = CANDIDATES, block_rows: int | None = None) -> DataFrame:
    """(test_id, train_id, label, distance, place): ``k`` near training rows of each test row, ties by train_id.

    Distances are exact, the rows are not all of the nearest: those in other cells than the visited are missed. On tables
    up to ``candidates`` rows all cells are visited. ``train`` has (id, vector, label), ``test`` has (id, vector).
    """
    rows, cell_rows = train.count(), CELL_ROWS
    trials = stage(test.orderBy(F.xxhash64("id", F.lit(42)), "id").limit(TRIALS).select("id", "vector"), "index-trials")
    sample, held = codebook_rows(train), []
    block_rows = block_rows or wide_block(sample.shape[1])
    if rows > candidates:  # the true neighbours of the trials, with their vectors
        told = stage(nearest_neighbours(train, trials, k).select("test_id", "train_id"), "index-told")
        of_train = train.select(F.col("id").alias("train_id"), F.col("vector").alias("near"))
        held = told.join(of_train, "train_id").join(trials, F.col("test_id") == F.col("id")).select("vector", "near").collect()
    while True:
        books = fit_codebooks(sample, rows, cell_rows=cell_rows)
        cells = len(books[0]) * len(books[1])
        probes = max(1, min(cells, -(-candidates // cell_rows)), _probes_for(books, held))
        if probes <= MOST_PROBES or cells <= MOST_PROBES:
            break
        cell_rows *= 4
    placed = stage(
        train.select(F.col("id").alias("train_id"), "vector", "label", F.element_at(_cells(books, 1)("vector"), 1).alias("cell")), "index-cells"
    )
    asked = stage(test.select(F.col("id").alias("test_id"), "vector", F.explode(_cells(books, probes)("vector")).alias("cell")), "index-probes")
    # A cell's rows of either side are counted in parts and cut in blocks, so that no task gets all rows of a crowded cell.
    left, of_train = _in_parts(placed, "train_id")
    right, of_test = _in_parts(asked, "test_id")
    train_blocks = of_train.groupBy("cell").agg(F.ceil(F.sum("n") / block_rows).cast("int").alias("train_blocks"))
    test_blocks = of_test.groupBy("cell").agg(F.ceil(F.sum("n") / QUERY_ROWS).cast("int").alias("test_blocks"))
    blocks = stage(train_blocks.join(test_blocks, "cell"), "index-blocks")
    sent = lambda parts: parts.select("cell", "part").join(blocks, "cell")
    left = left.join(sent(of_train), ["cell", "part"]).select(
        "train_id", "vector", "label", "cell", F.pmod(F.xxhash64("train_id", F.lit(1)), "train_blocks").cast("int").alias("t"),
        F.explode(F.sequence(F.lit(0), F.col("test_blocks") - 1)).alias("s"),
    )
    right = right.join(sent(of_test), ["cell", "part"]).select(
        "test_id", "vector", "cell", F.pmod(F.xxhash64("test_id", F.lit(1)), "test_blocks").cast("int").alias("s"),
        F.explode(F.sequence(F.lit(0), F.col("train_blocks") - 1)).alias("t"),
    )
    types = {c: train.schema[c].dataType.simpleString() for c in ("id", "label")}
    schema = f"test_id {test.schema['id'].dataType.simpleString()}, train_id {types['id']}, label {types['label']}, distance double"
    block = ["cell", "t", "s"]
    near = spread_by(left, block).groupBy(*block).cogroup(spread_by(right, block).groupBy(*block)).applyInPandas(_block_neighbours(k), schema)
    place = F.row_number().over(Window.partitionBy("test_id").orderBy("distance", "train_id"))
    return near.withColumn("place", place).where(F.col("place") <= k)


def _probes_for(books, held) -> int:
    """Nearest cells that a row must visit to meet ``WANTED`` of the pairs (vector, vector of a true neighbour)."""
    import numpy as np

    half, places = books[0].shape[1], []
    for vector, near in held:
        x, y = np.array(vector, dtype=float)[None], np.array(near, dtype=float)[None]
        a, b = _squares(x[:, :half], books[0])[0], _squares(x[:, half:], books[1])[0]
        reach = a[_squares(y[:, :half], books[0])[0].argmin()] + b[_squares(y[:, half:], books[1])[0].argmin()]
        places.append(np.searchsorted(np.sort(b), reach + 1e-9 * (1.0 + abs(reach)) - a, "right").sum())
    return int(np.sort(places)[max(0, math.ceil(WANTED * len(places)) - 1)]) if places else 1


def _in_parts(rows: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """The rows with a ``part`` by their id, and the rows ``n`` of each cell and part."""
    split = rows.withColumn("part", F.pmod(F.xxhash64(name), F.lit(SPLITS)))
    return split, split.groupBy("cell", "part").agg(F.count("*").alias("n"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: ``pairs`` of the exact neighbours, and the share ``recall`` of them that was found."""
    found, exact = (stage(x, "neighbours").select("test_id", "train_id") for x in (found, exact))
    hit = exact.join(found.withColumn("hit", F.lit(1)), ["test_id", "train_id"], "left")
    return hit.agg(F.count("*").alias("pairs"), (F.count("hit") / F.count("*")).alias("recall"))
