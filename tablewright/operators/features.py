"""Feature preparation: selection, splits, encoding, scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import DATETIME, as_double, columns_of_kind, hash_below, hash_text, present, quoted
from ..functions.running import positions
from ..functions.tables import union_all
from ..session import stage
from . import profile

MAX_CATEGORIES = 50
INFREQUENT = "infrequent"


def select_features(df: DataFrame, target: str) -> DataFrame:
    """All columns but the target and the dates."""
    drop = {target, *columns_of_kind(df, DATETIME)}
    return df.select(*[quoted(c) for c in df.columns if c not in drop])


def train_test_split(df: DataFrame, key: Sequence[str], test_size: float = 0.2) -> DataFrame:
    """Adds ``split``: each row's side follows from its key alone, at any partitioning."""
    test = hash_below(test_size, *[quoted(k) for k in key])
    return df.withColumn("split", F.when(test, "test").otherwise("train"))


def stratified_split(df: DataFrame, key: Sequence[str], target: str, test_size: float = 0.2) -> DataFrame:
    """Adds ``split`` with a test share of ceil(test_size x rows) in every class.

    Rows are ordered by a hash of their key inside each class, and the first ones
    are the test rows. Rows with the same key are told apart by their number in
    the written table, whose hash orders them. Hashes are counted in 65,536
    ranges per class; in the range that holds the border the whole hashes are
    counted, and only the rows of one hash are ranked. Falls back to the plain
    split when a class has fewer than two rows.
    """
    kept = stage(df.withColumn("__id", F.monotonically_increasing_id()), "to-split")
    place = F.concat(hash_text(*[quoted(k) for k in key]), F.substring(F.md5(F.col("__id").cast("string")), 1, 4))
    coded = kept.select(quoted(target).alias("__y"), place.alias("__q"), F.substring(place, 1, 4).alias("__r"), "__id")
    ranges = stage(coded.groupBy("__y", "__r").agg(F.count(F.lit(1)).alias("n")), "ranges")
    whole = Window.partitionBy("__y")
    borders = ranges.select(
        "__y", "__r", (F.sum("n").over(whole.orderBy("__r")) - F.col("n")).alias("before"), F.sum("n").over(whole).alias("size"), "n"
    ).withColumn("wanted", F.ceil(F.col("size") * F.lit(test_size)))
    smallest = borders.agg(F.min("size")).first()[0]
    if smallest is None or smallest < 2:
        return train_test_split(df, key, test_size)
    border = stage(
        borders.where("before < wanted and before + n >= wanted").select(
            F.col("__y").alias("__class"), F.col("__r").alias("__range"), (F.col("wanted") - F.col("before")).alias("left")
        ),
        "borders",
    )
    near = stage(coded.join(border, F.col("__y").eqNullSafe(F.col("__class")) & (F.col("__r") == F.col("__range"))), "near")
    steps = near.groupBy("__class", "left", "__q").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.sum("n").over(Window.partitionBy("__class").orderBy("__q"))
    edges = stage(
        steps.withColumn("up_to", up_to).where("up_to >= left and up_to - n < left").select(
            "__class", F.col("__q").alias("__edge"), (F.col("left") - F.col("up_to") + F.col("n")).alias("take")
        ),
        "edges",
    )
    near = near.drop("__class", "__range", "left")
    tied = near.join(edges, F.col("__y").eqNullSafe(F.col("__class")) & (F.col("__q") == F.col("__edge")))
    rank = F.row_number().over(Window.partitionBy("__class", "__edge").orderBy("__id"))
    last = stage(tied.withColumn("rank", rank).where("rank = take").select("__class", "__edge", F.col("__id").alias("__last")), "last")
    sides = kept.withColumn("__q", place).join(last, quoted(target).eqNullSafe(F.col("__class")), "left")
    test = (F.col("__q") < F.col("__edge")) | ((F.col("__q") == F.col("__edge")) & (F.col("__id") <= F.col("__last")))
    return sides.select(*[quoted(c) for c in df.columns], F.when(test, "test").otherwise("train").alias("split"))


def label_index(df: DataFrame, target: str) -> DataFrame:
    """(label, index) with indices 0..k-1 in label order; one row per class."""
    labels = df.select(present(df, target).alias("label")).where("label is not null").distinct()
    return positions(labels, "label", "index")


def label_encode(df: DataFrame, target: str, output: str = "label_index") -> DataFrame:
    index = label_index(df, target).select(F.col("label").alias("__label"), F.col("index").alias(output))
    return df.join(index, quoted(target) == F.col("__label"), "left").drop("__label")


def fit_scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a constant column gets deviation 1."""
    row = df.agg(
        *[F.struct(F.avg(as_double(df, c)), F.stddev_pop(as_double(df, c))).alias(f"s{i}") for i, c in enumerate(columns)]
    ).first()
    return {c: (row[f"s{i}"][0] or 0.0, row[f"s{i}"][1] or 1.0) for i, c in enumerate(columns)}


def standard_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    fitted = fit_scaling(df, columns)
    return df.withColumns({c: (as_double(df, c) - F.lit(fitted[c][0])) / F.lit(fitted[c][1]) for c in columns})


def fit_categories(df: DataFrame, columns: Sequence[str], most: int = MAX_CATEGORIES) -> dict[str, tuple[list[str], bool]]:
    """Categories kept per column and whether others are pooled.

    All are kept up to ``most``; beyond that the ``most - 1`` most frequent, the pool being one more.
    """
    branches = []
    for c in columns:
        counts = profile.value_counts(df.select(present(df, c).cast("string").alias("v")), "v")
        top = counts.orderBy(F.desc("n"), "value").limit(most + 1)  # a top-k, to learn whether the limit is passed
        branches.append(top.select(F.lit(c).alias("column"), "value", "n"))
    found: dict[str, list] = {c: [] for c in columns}
    for row in union_all(branches).collect():
        found[row["column"]].append((-row["n"], row["value"]))
    return {
        c: (sorted(v for _, v in (sorted(values)[: most - 1] if len(values) > most else values)), len(values) > most)
        for c, values in found.items()
    }


def category(text: Column, kept: Sequence[str], pool: bool) -> Column:
    """The category a value counts as; null for missing and, without a pool, for unknown values."""
    known = F.when(text.isin(list(kept)), text)
    return known.otherwise(F.when(text.isNotNull(), INFREQUENT)) if pool else known


def one_hot_encode(df: DataFrame, key: Sequence[str], columns: Sequence[str], most: int = MAX_CATEGORIES) -> DataFrame:
    """Long form: one row per row and category that applies, with value 1; the rarest categories share one."""
    fitted = fit_categories(df, columns, most)
    cells = []
    for c in columns:
        value = category(present(df, c).cast("string"), *fitted[c])
        cells.append(F.when(value.isNotNull(), F.struct(F.lit(c).alias("feature"), value.alias("category"))))
    present_cells = F.filter(F.array(*cells), lambda x: x.isNotNull())
    return df.select(*[quoted(k) for k in key], F.inline(present_cells)).withColumn("value", F.lit(1))
