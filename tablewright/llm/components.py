"""Connected components of a graph given by its links."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..session import stage


def state(links: DataFrame) -> tuple:
    """Count and order-free checksum: equal for equal sets of links."""
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """``vertex, root`` for every vertex of the links ``a, b``; the root is the component's smallest vertex.

    Large-star and small-star steps in turn: every vertex hands the smallest vertex known to it to its neighbours, above
    and then below it, until each component is a star. Neighbours are never gathered, only their minimum is, which is
    combined before the shuffle. Each round is a written table.
    """
    both = lambda e: e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    now = stage(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    known = state(now)
    while known[0]:
        sides = both(now)
        least = sides.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = sides.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        large = stage(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        joined = large.join(least, "a")
        small = joined.where("b != least").select(F.col("b").alias("a"), F.col("least").alias("b")).unionByName(
            least.select("a", F.col("least").alias("b"))
        )
        now = stage(small.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "small-star")
        before, known = known, state(now)
        if known == before:
            break
    stars = now.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    return stars.unionByName(now.select(F.col("b").alias("vertex"), F.col("b").alias("root")).distinct())
