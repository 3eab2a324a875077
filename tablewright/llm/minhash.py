"""Near-duplicates by MinHash: least values of many universal hash functions, bands of them, and sets of shingles that decide.

Texts with equal sets are one class. Two classes are candidates where a band, five minima in a row, is equal; at a
similarity of 0.85 none of 36 bands is with a probability under 1e-9. A class meets leaders of its buckets, and the
signatures tell which of these pairs are worth their full sets. What such pairs do not connect, though it stands in one
bucket, is searched through the rarest shingles, so that no bucket is compared pair by pair.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from . import pairs
from .pairs import Share
from .skew import beside
from .texts import mix, on_texts, ready, small_or_plain

BANDS, ROWS = 36, 5
LOSS = 1e-9  # probability of a pair at the least similarity that its signatures miss


def functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and additions of universal hash functions of 64 bits: h(x) = (a x + b) mod 2^64, of which the upper half counts."""
    numbers = mix(np.arange(2 * count))
    return numbers[:count] | np.uint64(1), numbers[count:]


def signatures(hashes: np.ndarray, bounds: np.ndarray, count: int) -> np.ndarray:
    """The least value of each function over each set, one row a set; sets must not be empty."""
    out = np.zeros((len(bounds) - 1, count), np.int32)
    if len(hashes):
        with np.errstate(over="ignore"):
            for k, (a, b) in enumerate(zip(*functions(count))):
                out[:, k] = (np.minimum.reduceat(hashes * a + b, bounds[:-1]) >> np.uint64(32)).astype(np.uint32).view(np.int32)
    return out


def band_keys(minima: np.ndarray) -> np.ndarray:
    """A 64-bit name of each band of each signature."""
    values = minima.view(np.uint32).astype(np.uint64).reshape(len(minima), BANDS, ROWS)
    keys = np.tile(np.arange(BANDS, dtype=np.uint64), (len(minima), 1))
    with np.errstate(over="ignore"):
        for j in range(ROWS):
            keys = mix(keys + values[:, :, j])
    return keys.view(np.int64)


def marks(text: Column, words: int) -> Column:
    """``struct<n_shingles, hi, lo, signature, bands>`` of a whole text; one without words has no signature and no bands.

    Bands are named by whole minima; of each minimum the signature keeps the last byte, which is equal for equal minima
    and for one in 256 others.
    """

    def one(texts: pa.Array) -> pa.Array:
        hashes, bounds = pairs.shingle_numbers(texts, words)
        hi, lo = pairs.digests(hashes, bounds)
        n = np.diff(bounds)
        minima = signatures(hashes, np.unique(bounds), BANDS * ROWS) if len(hashes) else np.zeros((0, BANDS * ROWS), np.int32)

        def lists(values: np.ndarray) -> pa.Array:
            at = np.concatenate([[0], np.cumsum(np.where(n > 0, values.shape[1], 0))]).astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(at), pa.array(values.ravel()))

        fields = [pa.array(n), pa.array(hi), pa.array(lo), lists(minima.astype(np.int8)), lists(band_keys(minima))]
        return pa.StructArray.from_arrays(fields, ["n_shingles", "hi", "lo", "signature", "bands"])

    return on_texts(lambda: one, "struct<n_shingles long, hi long, lo long, signature array<tinyint>, bands array<long>>")(text)


def least_agreement(count: int, least: Share) -> int:
    """The most equal minima that a pair at the least similarity falls short of with a probability of ``LOSS`` at most."""
    p, short = least[0] / least[1], 0.0
    for k in range(count + 1):
        short += comb(count, k) * p**k * (1 - p) ** (count - k)
        if short > LOSS:
            return k
    return count


def agreeing(candidates: DataFrame, classes: DataFrame, least: Share) -> DataFrame:
    """The pairs ``a, b`` whose signatures agree often enough."""
    one = classes.select(F.col("vertex").alias("a"), F.col("signature").alias("of_a"))
    other = classes.select(F.col("vertex").alias("b"), F.col("signature").alias("of_b"))
    both = candidates.join(one, "a").join(other, "b")
    equal = F.size(F.filter(F.arrays_zip("of_a", "of_b"), lambda x: x["of_a"] == x["of_b"]))
    return both.where(equal >= least_agreement(BANDS * ROWS, least)).select("a", "b")


def buckets(keyed: DataFrame) -> DataFrame:
    """``key, vertex, n, leader``: the bands that at least two classes share, their number, and one of them."""
    sized = keyed.groupBy("key").agg(F.count("*").alias("n"), F.min(F.col("vertex").bitwiseXOR(F.col("key"))).alias("least")).where("n > 1")
    return stage(keyed.join(sized.select("key", "n", F.col("least").bitwiseXOR(F.col("key")).alias("leader")), "key"), "buckets")


def full_sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """``vertex, shingles`` of the classes named in ``wanted``, from the text of one document of each."""
    named = stage(classes.join(wanted, "vertex").select("vertex", "hi", "lo", F.col("least").alias("id")), "suspects")
    ids = small_or_plain(named.select("id").distinct(), "suspect-ids")
    found = docs.join(ids, docs.doc_id.eqNullSafe(ids.id), "left_semi").select(pairs.sets(F.col("text"), words).alias("s"))
    # Keys that cannot be null: a test of them would be moved before the semi join, and the function with it over all texts.
    found = found.select(*[F.coalesce(f"s.{k}", F.lit(0)).alias(k) for k in ("hi", "lo")], "s.shingles")
    return stage(found.join(named, ["hi", "lo"]).select("vertex", "shingles").dropDuplicates(["vertex"]), "full-sets")


def linked_classes(docs: DataFrame, classes: DataFrame, keyed: DataFrame, words: int, least: Share) -> DataFrame:
    """``vertex, root`` of all classes that have a link, over any number of links."""
    met, sets = buckets(keyed), {}

    def confirm(tried: DataFrame) -> DataFrame:
        likely = stage(agreeing(tried, classes, least), "likely")
        new = stage(likely.select(F.explode(F.array("a", "b")).alias("vertex")).distinct(), "suspects")
        learn(new if not sets else new.join(sets["known"].select("vertex"), "vertex", "left_anti"))
        return pairs.confirmed(likely, sets["known"], least)

    def learn(new: DataFrame) -> None:
        more = full_sets(docs, classes, new, words)
        sets["known"] = sets["known"].unionByName(more) if sets else more

    roots = pairs.through_leaders(met, confirm)
    # In buckets of three or more all pairs of different components are still to be excluded.
    apart = pairs.still_apart(met, roots)
    new = apart.select("vertex").join(sets["known"].select("vertex"), "vertex", "left_anti")
    learn(new)
    members = sets["known"].join(apart.select("vertex"), "vertex", "left_semi")
    return pairs.through_prefixes(members, least, confirm, roots)


def near_duplicates(docs: DataFrame, words: int = 5, least: Share = (85, 100)) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every row of ``docs``.

    Texts are linked if their sets of distinct ``words``-word shingles have a Jaccard similarity of ``least`` (numerator,
    denominator) or more; ``component_id`` is the smallest id that links reach, of the row itself without one. A null text
    and one without words have an empty set and no link. Rows with equal sets are one class, repeated rows too; a null
    ``doc_id`` is never the smallest, unless a group has no other. Other columns are not read.
    """
    ready(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    marked = stage(docs.withColumn("m", marks(F.col("text"), words)).select("doc_id", "m.*", F.monotonically_increasing_id().alias("row")), "marks")
    sets = marked.where("n_shingles > 0").groupBy("hi", "lo").agg(F.min("row").alias("vertex"), F.min("doc_id").alias("least"))
    sets = stage(sets, "sets")
    classes = stage(sets.join(marked.select(F.col("row").alias("vertex"), "signature"), "vertex"), "classes")
    keyed = stage(marked.select(F.col("row").alias("vertex"), F.explode("bands").alias("key")).join(sets.select("vertex"), "vertex", "left_semi"), "bands")
    roots = linked_classes(docs, classes, keyed, words, least)
    of_class = classes.select("vertex", "hi", "lo", "least").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    smallest = of_class.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stage(of_class.select("hi", "lo", "root").join(smallest, "root").select("hi", "lo", "component_id"), "class-components")
    keyed = marked.select("doc_id", "n_shingles", "hi", "lo", "row").withColumn("key", F.struct("hi", "lo"))
    table = named.select(F.struct("hi", "lo").alias("key"), "component_id")
    told = beside(keyed, table, "key", "row", "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return told.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))
