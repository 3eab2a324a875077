"""Near-duplicates by SimHash: fingerprints, and BK-trees that find those within a few bits.

Two fingerprints that differ in at most r bits agree in one of r + 1 blocks of bits. A shard is
the fingerprints that agree in a block; it is one BK-tree, in which a child hangs on its parent
by their integer Hamming distance, so that a search follows only the edges within r of its own
distance. All trees together grow with the corpus, so they are dealt over the cluster rather
than broadcast, and a fingerprint is looked up in the trees of its own shards only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from . import pairs
from .components import components
from .minhash import buckets, signatures
from .skew import beside
from .texts import BLANK, mix, on_texts, raw, ready, small_or_plain, spans

SEED = 42
ALL = (1 << 64) - 1
SHARDS, MINIMA = 24, 3  # shards a text is in when shingles decide, and least hashes that name one
FAR = 24  # bits in which texts of Jaccard similarity 0.8 differ in all but one of a million pairs
TREE = 1024  # fingerprints in a tree; a larger shard is dealt again by blocks of the bits it does not agree in yet


def shingle_bounds(firsts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last word of every shingle, and the n + 1 bounds of the texts' shingles.

    A text of fewer words than a shingle has one of all its words, a text without words has none.
    """
    length = np.diff(firsts)
    many = np.where(length > 0, np.maximum(length - words + 1, 1), 0)
    bounds = np.concatenate([[0], np.cumsum(many)])
    first = np.arange(bounds[-1]) + np.repeat(firsts[:-1] - bounds[:-1], many)
    return first, np.minimum(first + words, np.repeat(firsts[1:], many)) - 1, bounds


def shingle_hashes(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of all shingles of words in small letters joined by single spaces, and the texts' n + 1 bounds."""
    data, bounds = raw(texts)
    data, bounds = np.insert(data, bounds[1:], 0x20), bounds + np.arange(len(bounds))
    inside = ~BLANK[data]
    starts, ends, firsts = spans(inside, bounds)
    kept = inside.copy()
    kept[ends] = True  # one blank after each word
    joined = np.where(inside, data, 0x20)[kept]
    joined = np.where((joined >= 0x41) & (joined <= 0x5A), joined + 0x20, joined).astype(np.uint8)
    end = np.cumsum(ends - starts + 1) - 1
    first, last, shingles = shingle_bounds(firsts, words)
    begin = (end - (ends - starts))[first].tolist()
    view, digest = memoryview(joined.tobytes()), xxhash.xxh64_intdigest
    hashes = np.array([digest(view[a:b], SEED) for a, b in zip(begin, end[last].tolist())], np.uint64)
    return hashes, shingles


def majority(hashes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The bits set in over half of each text's hashes, as signed 64-bit integers; 0 without hashes."""
    found = np.zeros(len(bounds) - 1, np.int64)
    for i in np.flatnonzero(np.diff(bounds)):
        own = hashes[bounds[i] : bounds[i + 1]]
        set_bits = np.zeros(64, np.int64)
        for part in range(0, len(own), 1 << 14):
            set_bits += np.unpackbits(own[part : part + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        found[i] = np.packbits(2 * set_bits > len(own), bitorder="little").view(np.int64)[0]
    return found


def distinct(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's hashes once, ascending, and their n + 1 bounds."""
    own = [np.unique(hashes[a:b]) for a, b in zip(bounds, bounds[1:])]
    return np.concatenate([np.zeros(0, np.uint64), *own]), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])


def fingerprint(text: Column, words: int = 3) -> Column:
    """SimHash of the whole text as a long; 0 for a text that is null or has no words."""
    return on_texts(lambda: lambda texts: pa.array(majority(*shingle_hashes(texts, words))), "long")(text)


class Tree:
    """BK-tree over distinct fingerprints: nodes are numbers, a node's edges lead by distance to its children."""

    def __init__(self, radius: int) -> None:
        self.radius, self.values, self.edges = radius, [], []

    def near(self, value: int) -> list[int]:
        """Nodes within the radius."""
        found, todo = [], [0] if self.values else []
        while todo:
            node = todo.pop()
            distance = (self.values[node] ^ value).bit_count()
            if distance <= self.radius:
                found.append(node)
            edges = self.edges[node]
            todo += [edges[d] for d in range(distance - self.radius, distance + self.radius + 1) if d in edges]
        return found

    def add(self, value: int) -> None:
        node = 0
        while self.values:
            distance = (self.values[node] ^ value).bit_count()
            if distance not in self.edges[node]:
                self.edges[node][distance] = len(self.values)
                break
            node = self.edges[node][distance]
        self.values.append(value)
        self.edges.append({})


def spanning_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links within the radius that join what others leave apart: at most one fewer than values, and none is lost to them."""
    if len(values) == 2:  # most shards: the root and one search
        return [tuple(values)] if (values[0] ^ values[1]).bit_count() <= radius else []
    tree, parent, links = Tree(radius), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    for i, value in enumerate(values):
        for j in tree.near(value):
            a, b = root(i), root(j)
            if a != b:
                parent[b] = a
                links.append((values[j], value))
        tree.add(value)
    return links


def tree_links(radius: int):
    """Column function array<long> -> array<struct<a, b>>."""

    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
        for part in parts:
            found = [spanning_links(sorted(v & ALL for v in x), radius) for x in part.to_pylist()]
            yield pa.array([[{"a": signed(a), "b": signed(b)} for a, b in x] for x in found], kind)

    run.__annotations__ = {"parts": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "array<struct<a long, b long>>")


def signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def finer(mask: int, radius: int) -> list[int]:
    """Masks that add to ``mask`` one of ``radius`` + 1 blocks of the other bits."""
    free = [b for b in range(64) if not mask >> b & 1]
    cuts = [len(free) * i // (radius + 1) for i in range(radius + 2)]
    return [mask | sum(1 << b for b in free[x:y]) for x, y in zip(cuts, cuts[1:])]


def links(values: DataFrame, radius: int = 2) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` of at most ``radius`` differing bits, enough to connect all that are linked.

    A shard larger than ``TREE`` is dealt again, by blocks of the bits in which its members may differ; pairs within the
    radius agree in one of these too. With every round fewer bits are open, and fingerprints that agree in all but ten
    bits are no more than 1,024, so the rounds end.
    """
    found, masks = None, finer(0, radius)
    rows = values.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    while True:
        rows = stage(rows.withColumn("part", F.col("fp").bitwiseAND(F.col("mask"))), "shards")
        sizes = stage(rows.groupBy("mask", "part").agg(F.count("*").alias("n")).where("n > 1"), "shard-sizes")
        large = sizes.where(F.col("n") > TREE)
        more = bool(large.take(1))
        own = rows.join(sizes.where(F.col("n") <= TREE).select("mask", "part"), ["mask", "part"], "left_semi")
        shards = own.groupBy("mask", "part").agg(F.collect_list("fp").alias("fps"))  # TREE values at most
        step = shards.select(F.inline(tree_links(radius)(F.col("fps"))))
        found = step if found is None else found.unionByName(step)
        if not more:
            return found
        children = {m: finer(m, radius) for m in masks}
        table = F.create_map(*[x for m, c in children.items() for x in (F.lit(signed(m)), F.array(*[F.lit(signed(k)) for k in c]))])
        hot = rows.join(large.select("mask", "part"), ["mask", "part"], "left_semi")
        rows = hot.select("fp", F.explode(table[F.col("mask")]).alias("mask")).distinct()
        masks = sorted({k for c in children.values() for k in c})


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """Add ``fp``, the SimHash of the whole ``text``; a column of this name is replaced."""
    ready(docs.sparkSession)
    return docs.withColumn("fp", fingerprint(F.col("text"), words))


def groups(marked: DataFrame, radius: int = 2) -> DataFrame:
    """``fp, component_id``: for each distinct fingerprint the smallest ``doc_id`` of all rows it is linked with, over any number of links.

    Rows with the same fingerprint, texts without words among them, are one vertex. A null ``doc_id`` is never the
    smallest unless a group has no other.
    """
    least = stage(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprints")
    roots = stage(components(links(least.select("fp"), radius)), "components")
    joined = least.join(roots, least.fp == roots.vertex, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    smallest = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    return joined.select("fp", "root").join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 2) -> DataFrame:
    """``doc_id, fp, component_id`` of every row; documents with one ``component_id`` are near-duplicates of one another."""
    marked = stage(fingerprints(docs.select("doc_id", "text"), words).select("doc_id", "fp"), "marked")
    return marked.join(groups(marked, radius), "fp").select("doc_id", "fp", "component_id")


def hexadecimal(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def text_marks(text: Column, words: int) -> Column:
    """``struct<fp, content, shards>``: SimHash, hash of the word sequence, and the shards a text is in.

    Sets of shingles decide, so ``fp`` counts each shingle once, however often a line is repeated. A shard is named by
    ``MINIMA`` least hashes of the text's shingles. Texts of Jaccard similarity 0.8 share none of the ``SHARDS`` with a
    probability of 3 in 100 million.
    """

    def one(texts: pa.Array) -> pa.Array:
        hashes, bounds = shingle_hashes(texts, words)
        full = np.flatnonzero(np.diff(bounds))
        contents, keys = np.zeros(len(texts), np.int64), np.zeros((len(full), SHARDS), np.int64)
        for i in full:
            contents[i] = np.uint64(xxhash.xxh64_intdigest(hashes[bounds[i] : bounds[i + 1]].tobytes(), SEED)).view(np.int64)
        hashes, bounds = distinct(hashes, bounds)
        if len(full):
            minima = signatures(hashes, np.unique(bounds), SHARDS * MINIMA).view(np.uint32).astype(np.uint64)
            with np.errstate(over="ignore"):
                for k in range(SHARDS):
                    key = np.full(len(full), k, np.uint64)
                    for j in range(MINIMA):
                        key = mix(key + minima[:, MINIMA * k + j])
                    keys[:, k] = key.view(np.int64)
        at = np.concatenate([[0], np.cumsum(np.where(np.diff(bounds) > 0, SHARDS, 0))]).astype(np.int32)
        shards = pa.ListArray.from_arrays(pa.array(at), pa.array(keys.ravel()))
        return pa.StructArray.from_arrays([pa.array(majority(hashes, bounds)), pa.array(contents), shards], ["fp", "content", "shards"])

    return on_texts(lambda: one, "struct<fp long, content long, shards array<long>>")(text)


def close_pairs(different: DataFrame, radius: int) -> DataFrame:
    """Pairs ``a, b`` of rows that connect all whose fingerprints are within ``radius`` bits, by the trees of ``links``."""
    first = stage(different.groupBy("fp").agg(F.min("row").alias("first")), "fingerprints")
    same = beside(different.select("row", "fp"), first, "fp", "row").where("row != first").select(F.col("row").alias("a"), F.col("first").alias("b"))
    near = links(first.select("fp"), radius)
    one, other = (first.select(F.col("fp").alias(x), F.col("first").alias(f"row_{x}")) for x in ("a", "b"))
    return same.unionByName(near.join(one, "a").join(other, "b").select(F.col("row_a").alias("a"), F.col("row_b").alias("b")))


def shingle_links(different: DataFrame, numbered: DataFrame, words: int, least: pairs.Share, radius: int) -> DataFrame:
    """``vertex, root``: components of the links between texts of different words, of all texts that have a link."""
    trees = stage(close_pairs(different, radius), "tree-pairs")
    members = buckets(stage(different.select(F.col("row").alias("vertex"), F.explode("shards").alias("key")), "keyed"))
    known: list[DataFrame] = []

    def confirm(tried: DataFrame, far: int = FAR) -> DataFrame:
        likely = stage(within(tried, different, far), "likely")
        new = likely.select(F.explode(F.array("a", "b")).alias("vertex")).distinct()
        learn(new if not known else new.join(known[-1].select("vertex"), "vertex", "left_anti"))
        return pairs.confirmed(likely, known[-1], least)

    def learn(wanted: DataFrame) -> None:
        ids = small_or_plain(wanted.select(F.col("vertex").alias("__row")), "suspects")
        found = numbered.join(ids, "__row", "left_semi")
        sets = stage(found.select(F.col("__row").alias("vertex"), pairs.sets(F.col("text"), words).alias("s")).select("vertex", "s.shingles"), "shingles")
        known.append(known[-1].unionByName(sets) if known else sets)

    roots = stage(components(stage(confirm(trees, 64), "links")), "components")
    roots = pairs.through_leaders(members, confirm, roots)
    # In shards of three or more no pair of different components is left out: it shares a rare shingle.
    apart = pairs.still_apart(members, roots)
    learn(apart.select("vertex").join(known[-1].select("vertex"), "vertex", "left_anti"))
    members = known[-1].join(apart.select("vertex"), "vertex", "left_semi")
    return pairs.through_prefixes(members, least, confirm, roots)


def within(found: DataFrame, different: DataFrame, far: int) -> DataFrame:
    """The pairs ``a, b`` whose fingerprints differ in ``far`` bits at most."""
    one, other = (different.select(F.col("row").alias(x), F.col("fp").alias(f"fp_{x}")) for x in ("a", "b"))
    both = found.join(one, "a").join(other, "b")
    return both.where(F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= far).select("a", "b")


def deduplicate(docs: DataFrame, words: int = 5, least: pairs.Share = (4, 5), radius: int = 3) -> DataFrame:
    """One row of ``docs`` of each group of near-duplicates, with its own columns: that of the smallest id, or the first read.

    Two texts are near-duplicates if their sets of ``words``-word shingles (A to Z made small) have a Jaccard similarity
    of ``least`` (numerator, denominator) or more; a group is what such pairs connect, over any number of them. Texts of
    the same words, and texts without any, are copies. Rows without an id come after those with one. Copies are dropped
    first, by a hash of their words. Of the others the trees give those within ``radius`` bits, and shards those farther
    apart; shingles decide, and what no link connects though it shares a shard is searched by rare shingles.
    """
    ready(docs.sparkSession)
    numbered = stage(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    place = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.col("__row").alias("row"))
    marked = numbered.select(F.col("__row").alias("row"), place.alias("place"), text_marks(F.col("text"), words).alias("m"))
    marked = stage(marked.select("row", "place", "m.*"), "text-marks")
    first = stage(marked.groupBy("content").agg(F.min("place").alias("place")).select("place.row"), "first-copies")  # combined before the shuffle
    copies = marked.join(first, "row", "left_anti").select("row")
    different = stage(marked.join(first, "row", "left_semi").select("row", "fp", "shards"), "different")
    roots = shingle_links(different, numbered, words, least, radius)
    grouped = marked.select("row", "place").join(roots, F.col("row") == F.col("vertex"))
    kept = grouped.groupBy("root").agg(F.min("place").alias("place")).select(F.col("place.row").alias("row"))
    followers = roots.select(F.col("vertex").alias("row")).join(kept, "row", "left_anti")
    gone = small_or_plain(copies.unionByName(followers).select(F.col("row").alias("__row")).distinct(), "dropped")
    return numbered.join(gone, "__row", "left_anti").drop("__row")
