"""Pairs of texts decided by their sets of shingles: who meets whom, the test of a pair, and an exact search."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .components import components
from .skew import beside
from .texts import BLANK, codes, mix, on_texts, raw, spans

TILE = 64  # rows of one shingle that meet the others of that shingle in one block
Share = tuple[int, int]  # numerator and denominator of a least similarity


def shingle_numbers(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of each text as ascending 64-bit hashes, and the texts' n + 1 bounds.

    Words are in small letters (A to Z). A text of fewer words than a shingle has one of all its words.
    """
    data, bounds = raw(texts)
    data, bounds = np.insert(data, bounds[1:], 0x20), bounds + np.arange(len(bounds))
    inside = ~BLANK[data]
    starts, ends, firsts = spans(inside, bounds)
    capital = (data >= 0x41) & (data <= 0x5A)
    number, distinct = codes(data + (capital.view(np.uint8) << 5), inside, starts, ends)
    word = np.array([xxhash.xxh64_intdigest(w) for w in distinct.to_pylist()], np.uint64)[number] if len(number) else np.zeros(0, np.uint64)
    length = np.diff(firsts)
    many = np.where(length > 0, np.maximum(length - words + 1, 1), 0)
    at = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(at[-1]) + np.repeat(firsts[:-1] - at[:-1], many)
    last = np.minimum(first + words, np.repeat(firsts[1:], many)) - 1
    hashes = np.zeros(len(first), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(words):
            more = first + j <= last
            hashes[more] = mix(hashes[more] * np.uint64(31) + word[(first + j)[more]])
    text = np.repeat(np.arange(len(texts)), many)
    order = np.lexsort((hashes, text))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    return hashes[new], np.searchsorted(text[new], np.arange(len(texts) + 1))


def digests(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit numbers for each set; equal sets have equal ones, and an empty set has zeros."""
    out = np.zeros((2, len(bounds) - 1), np.int64)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        for k in (0, 1):
            out[k, full] = np.add.reduceat(mix(hashes ^ mix(np.array([1000 + k]))), bounds[full]).view(np.int64)
    return out


def sets(text: Column, words: int) -> Column:
    """``struct<hi, lo, shingles>``: the set's digest, and its hashes."""

    def one(texts: pa.Array) -> pa.Array:
        hashes, bounds = shingle_numbers(texts, words)
        hi, lo = digests(hashes, bounds)
        shingles = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(hashes.view(np.int64)))
        return pa.StructArray.from_arrays([pa.array(hi), pa.array(lo), shingles], ["hi", "lo", "shingles"])

    return on_texts(lambda: one, "struct<hi long, lo long, shingles array<long>>")(text)


def confirmed(pairs: DataFrame, members: DataFrame, least: Share) -> DataFrame:
    """The pairs ``a, b`` whose ``members`` (``vertex``, ``shingles``) have a Jaccard similarity of ``least`` or more."""
    one = members.select(F.col("vertex").alias("a"), F.col("shingles").alias("of_a"))
    other = members.select(F.col("vertex").alias("b"), F.col("shingles").alias("of_b"))
    both = beside(pairs.select("a", "b").join(one, "a"), other, "b", "a")  # a leader may be the other of many
    sized = both.select("a", "b", F.size(F.array_intersect("of_a", "of_b")).cast("long").alias("n"), (F.size("of_a") + F.size("of_b")).cast("long").alias("sum"))
    return sized.where(least[1] * F.col("n") >= least[0] * (F.col("sum") - F.col("n"))).select("a", "b")


def rooted(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs ``a, b`` that the components ``roots`` (``vertex, root``) do not connect."""
    one = roots.select(F.col("vertex").alias("a"), F.col("root").alias("root_a"))
    other = roots.select(F.col("vertex").alias("b"), F.col("root").alias("root_b"))
    known = pairs.join(one, "a", "left").join(other, "b", "left")
    return known.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")


def through_leaders(met: DataFrame, confirm: Callable[[DataFrame], DataFrame], roots: DataFrame | None = None) -> DataFrame:
    """Components (``vertex, root``) of the links that ``confirm`` finds among members of one bucket.

    ``met`` has ``key, vertex, n, leader``: a bucket of ``n`` vertices and one of them, another in every bucket. A vertex
    tries the leader of its largest bucket, then that of any, so that the pairs do not exceed the vertices however large the
    buckets are. Pairs that are a bucket of their own are all tried.
    """
    pair = met.where("vertex != leader").select("key", "n", F.col("vertex").alias("a"), F.col("leader").alias("b"))
    another = pair.groupBy("a").agg(F.max_by("b", F.xxhash64("key", "b")).alias("b"))
    for tried in (pair.groupBy("a").agg(F.max_by("b", "n").alias("b")), another.unionByName(pair.where("n = 2").select("a", "b")).distinct()):
        found = confirm(tried if roots is None else rooted(tried, roots))
        roots = stage(components(stage(found if roots is None else found.unionByName(as_links(roots)), "links")), "components")
    return roots


def as_links(roots: DataFrame) -> DataFrame:
    return roots.select(F.col("vertex").alias("a"), F.col("root").alias("b"))


def still_apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """``vertex, root`` of the members of buckets, those of two left out, that are not of one component."""
    inside = met.where("n > 2").select("key", "vertex").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    mixed = inside.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")
    return stage(inside.join(mixed, "key", "left_semi").select("vertex", "root").distinct(), "apart")


def prefixes(members: DataFrame, least: Share) -> DataFrame:
    """``vertex, n, typical, at, s`` of ``members`` (``vertex``, ``shingles``): the shingles of its prefix that others have, and their places.

    Shingles are ordered by the number of members that have them, the rarest first. Two sets that are similar enough share
    one of their first n - ceil(least * n) + 1 shingles. What many texts have in common stands last, in no prefix. ``typical`` is
    the mean logarithm of the members that have a text's shingles: the least altered one of many altered copies has the largest.
    """
    share, whole = least
    rows = stage(members.select("vertex", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("s")), "postings")
    counted = rows.groupBy("s").agg(F.count("*").alias("df")).where("df > 1")
    ranked = beside(rows, counted, "s", "vertex", "left").groupBy("vertex", "n").agg(
        F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "s"))).alias("order")  # of one text
    )
    first = (F.col("n") - F.ceil(share * F.col("n") / whole) + 1).cast("int")
    typical = F.aggregate("order", F.lit(0.0), lambda x, e: x + F.log(e["df"].cast("double"))) / F.size("order")
    heads = ranked.select("vertex", "n", typical.alias("typical"), F.posexplode(F.slice("order", F.lit(1), first)).alias("at", "e")).where("e.df > 1")
    return stage(heads.select("vertex", "n", "typical", "at", F.col("e.s").alias("s")), "prefixes")


def prefix_pairs(heads: DataFrame, roots: DataFrame, least: Share) -> DataFrame:
    """Pairs ``a, b`` of different ``roots`` that share a shingle of their prefixes ``heads``, all similar ones among them.

    What follows the first shared shingle must leave room for the overlap they need. A pair has a row that is not of the largest of a
    shingle's components; only these rows are sent to all blocks in which the shingle's rows lie, so that no task has to hold one shingle's.
    """
    share, whole = least
    rows = heads.select("vertex", "n", "at", "s").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    rows = stage(rows, "rooted-prefixes")
    parts = rows.groupBy("s", "root").agg(F.count("*").alias("m"))
    groups = parts.groupBy("s").agg(F.sum("m").alias("m"), F.count("*").alias("parts"), F.max_by("root", F.struct("m", "root")).alias("largest")).where("parts > 1")
    rows = rows.join(groups.select("s", "m", "largest"), "s").withColumn("blocks", F.ceil(F.col("m") / TILE).cast("int"))
    named = lambda side: [F.col(c).alias(f"{c}_{side}") for c in ("vertex", "root", "n", "at")]
    x = rows.select("s", "largest", F.pmod(F.xxhash64("vertex", "s"), "blocks").cast("int").alias("block"), *named("x"))
    y = rows.where("root != largest").select("s", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *named("y"))
    room = F.least(F.col("n_x") - F.col("at_x"), F.col("n_y") - F.col("at_y"))
    fits = (share + whole) * room >= share * (F.col("n_x") + F.col("n_y"))
    once = (F.col("root_x") == F.col("largest")) | (F.col("vertex_x") < F.col("vertex_y"))
    met = x.join(y, ["s", "block"]).where(once & (F.col("root_x") != F.col("root_y")) & fits)
    return met.select(F.least("vertex_x", "vertex_y").alias("a"), F.greatest("vertex_x", "vertex_y").alias("b")).distinct()


def through_prefixes(members: DataFrame, least: Share, confirm: Callable[[DataFrame], DataFrame], roots: DataFrame) -> DataFrame:
    """``roots`` with all links among ``members``: first with a leader of each shared shingle, then between what is still apart.

    The leader is the most typical vertex. Each vertex tries that of its rarest shared shingle and that of the most frequent one in its
    prefix, if of another component, so that groups which few links join are one before pairs across groups are listed: of many
    altered copies the least altered one is similar to nearly all, while two others often are not.
    """
    heads = prefixes(members.select("vertex", "shingles"), least)
    now = heads.select("vertex", "s", "typical").join(roots, "vertex", "left").withColumn("root", F.coalesce("root", "vertex"))
    now = stage(now, "led-prefixes")
    leader = F.max_by(F.struct("vertex", "root"), F.struct("typical", "vertex")).alias("leader")
    groups = now.groupBy("s").agg(F.count("*").alias("m"), leader, F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    led = now.join(groups.select("s", "m", "leader"), "s").where("root != leader.root")
    picked = led.groupBy("vertex").agg(F.array_distinct(F.array(F.min_by("leader.vertex", "m"), F.max_by("leader.vertex", "m"))).alias("leaders"))
    tried = picked.select(F.col("vertex").alias("a"), F.explode("leaders").alias("b"))
    for step in (lambda: tried, lambda: prefix_pairs(heads, roots, least)):
        found = stage(confirm(step()), "links")
        if found.take(1):
            roots = stage(components(as_links(roots).unionByName(found)), "components")
    return roots
