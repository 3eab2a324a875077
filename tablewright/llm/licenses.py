"""License scans by diagonal voting.

All pairs of neighbouring words of all documents are joined to the places where templates have
them. A template that stands in a text from word d on votes for the diagonal d, so votes are
counted by diagonal; where words were put in or left out, the neighbouring diagonals are merged.
A span is verified by the share of the template's words that its votes cover, its key word among them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .decontaminate import IN_WORD
from .texts import mix, on_texts, per_text, raw, ready, spans

# Phrases that count wherever all their words stand one after the other.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Notices found with some words changed: label, words, and the word that tells a notice from its kin. At most 63 words.
NOTICES = [
    ("mit", "released under the mit license", "mit"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "sa"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache"),
    ("gpl", "licensed under the gnu general public license version 3", "general"),
    ("lgpl", "licensed under the gnu lesser general public license", "lesser"),
    ("as-is", "provided as is without warranty of any kind express or implied", "warranty"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license", "mozilla"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "permission"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "waived"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution"),
]
NEIGHBOURS = 2  # diagonals at most this far apart are merged
COVERED = 0.75  # of a notice's words
STRETCH = 1.5  # a span has at most so many times the notice's words


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words, A to Z made small, and the n + 1 bounds of the texts' words."""
    data, bounds = raw(texts)
    data = np.where((data >= 0x41) & (data <= 0x5A), data + 0x20, data).astype(np.uint8)
    inside = IN_WORD[data]
    starts, ends, firsts = spans(inside, bounds)
    if not len(starts):
        return np.zeros(0, np.uint64), firsts
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    within = np.arange(lengths.sum()) - np.repeat(begin, lengths)
    powers = mix(np.arange(1024)) | np.uint64(1)
    with np.errstate(over="ignore"):
        spread = (data[inside].astype(np.uint64) + np.uint64(1)) * powers[within % 1024] + (within // 1024).astype(np.uint64)
    return mix(np.add.reduceat(spread, begin)), firsts


def pairs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word with the next one of its text; the last word of a text has no pair."""
    words, firsts = word_hashes(texts)
    if not len(words):
        return np.zeros(0, np.int64), firsts
    with np.errstate(over="ignore"):
        both = mix(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    kept = np.ones(len(words), bool)
    kept[firsts[1:][np.diff(firsts) > 0] - 1] = False
    bounds = np.concatenate([[0], np.cumsum(kept)])[firsts]
    return both[kept[:-1]].view(np.int64), bounds


def rolling_pairs(text: Column) -> Column:
    """``array<long>`` of the pair hashes of a whole text, by place."""

    def one(texts: pa.Array) -> pa.Array:
        values, bounds = pairs(texts)
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values))

    return on_texts(lambda: one, "array<long>")(text)


def count_words(text: Column) -> Column:
    def one(texts: pa.Array) -> pa.Array:
        data, bounds = raw(texts)
        inside = IN_WORD[data] | ((data >= 0x41) & (data <= 0x5A))
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        before[bounds[:-1][np.diff(bounds) > 0]] = False
        return pa.array(per_text(inside & ~before, bounds))

    return on_texts(lambda: one, "long")(text)


def templates(spark: SparkSession, phrases: dict[str, str], notices: list[tuple[str, str, str]]) -> DataFrame:
    """``pair, place, template, label, words, need, fixed``: one row for each place of each template, a few hundred in all."""
    told = [(text, label, 0, True) for text, label in phrases.items()]
    told += [(text, label, 1 << text.split().index(key), False) for label, text, key in notices]
    values, bounds = pairs(pa.array([x[0] for x in told]))
    rows = [
        (int(values[i]), int(i - a), number, label, len(text.split()), need, fixed)
        for number, ((text, label, need, fixed), a, b) in enumerate(zip(told, bounds, bounds[1:]))
        for i in range(a, b)
    ]
    return spark.createDataFrame(rows, "pair long, place int, template int, label string, words int, need long, fixed boolean")


def row_key(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")


def votes(docs: DataFrame, table: DataFrame) -> DataFrame:
    """One row per row key, template and diagonal: the covered words of the template, as bits."""
    grams = row_key(docs).select("doc_id", "text_hash", F.posexplode(rolling_pairs(F.col("text"))).alias("at", "pair"))
    hits = grams.join(F.broadcast(table), "pair")  # the templates are a fixed list
    bits = F.expr("shiftleft(3L, place)")
    start = (F.col("at") - F.col("place")).cast("long").alias("diagonal")
    keys = ["doc_id", "text_hash", "template", "label", "words", "need", "fixed"]
    return hits.groupBy(*keys, start).agg(
        F.bit_or(bits).alias("bits"), F.min("at").alias("first"), (F.max("at") + 1).alias("last"),
    )


def best_stretches(diagonals: Column, words: Column, need: Column) -> Column:
    """Column ``array<struct<start, last, bits>>``: stretches of ``STRETCH`` times the words that cover enough of a notice.

    ``diagonals`` are ``first, last, bits`` of one group. Of stretches that overlap, the one that covers most stays, the
    shortest of these.
    """

    def one(group: list[dict], words: int, need: int) -> list[dict]:
        group = sorted(group, key=lambda x: x["first"])
        found = []
        for i, x in enumerate(group):
            stop, bits, last = x["first"] + int(STRETCH * words), 0, 0
            for j in range(i, len(group)):
                y = group[j]
                if y["first"] >= stop:
                    break
                if y["last"] < stop:
                    bits, last = bits | y["bits"], max(last, y["last"])
            if bits & need == need and bits.bit_count() >= COVERED * words:
                found.append({"start": x["first"], "last": last, "bits": bits})
        kept, taken = [], set()
        for x in sorted(found, key=lambda x: (-x["bits"].bit_count(), x["last"] - x["start"], x["start"])):
            own = range(x["start"], x["last"] + 1)
            if taken.isdisjoint(own):
                taken.update(own)
                kept.append(x)
        return kept

    def run(groups: pa.Array, words: pa.Array, need: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("last", pa.int64()), ("bits", pa.int64())]))
        return pa.array([one(g.as_py(), w, n) for g, w, n in zip(groups, words.to_pylist(), need.to_pylist())], kind)

    run.__annotations__ = {"groups": pa.Array, "words": pa.Array, "need": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<start long, last long, bits long>>")(diagonals, words, need)


def places(counted: DataFrame) -> DataFrame:
    """Verified spans: ``doc_id, text_hash, label, fixed, start, last, score``, one row each.

    All diagonals of a notice are merged with their neighbours, those of a single pair too: one word put in or left out
    of a short notice leaves such a pair. Pairs of everyday words can make a group longer than a notice, so coverage is
    that of stretches within a group.
    """
    exact = counted.where("fixed and bit_count(bits) = words").select(
        "doc_id", "text_hash", "label", "fixed", F.col("diagonal").alias("start"), "last", F.lit(1.0).alias("score")
    )
    keys = ["doc_id", "text_hash", "template"]
    order = Window.partitionBy(*keys).orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > NEIGHBOURS, F.lit(True))
    numbered = counted.where("not fixed").withColumn("far", far.cast("int")).withColumn("group", F.sum("far").over(order))
    merged = numbered.groupBy(*keys, "label", "words", "need", "fixed", "group").agg(
        F.bit_or("bits").alias("bits"), F.collect_list(F.struct("first", "last", "bits")).alias("diagonals")
    )
    # Most groups have too few words in all; the others are looked at one by one.
    known = F.col("bits").bitwiseAND(F.col("need")) == F.col("need")
    full = merged.where(known & (F.bit_count("bits") >= COVERED * F.col("words")))
    near = full.select("doc_id", "text_hash", "label", "fixed", "words", F.inline(best_stretches(F.col("diagonals"), F.col("words"), F.col("need"))))
    share = F.bit_count("bits") / F.col("words")
    return exact.unionByName(near.select("doc_id", "text_hash", "label", "fixed", "start", "last", share.alias("score")))


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, notices: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """All verified spans of ``docs``, see ``places``; ``start`` and ``last`` count words from 0.

    A phrase stands where all its words do, a notice where enough of them do. Texts without words have no rows. Rows are
    told apart by id and text, so repeated rows have their spans once.
    """
    ready(docs.sparkSession)
    table = templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    return places(votes(docs, table))


def summary(docs: DataFrame) -> DataFrame:
    """One row for every row of ``docs``: its words, its phrases and the labels of all its spans.

    ``n_words, n_base, first_word, last_word, base_labels, labels, score``; a text without spans, null and empty ones
    among them, has no places, empty labels and score 0. Repeated rows have equal results.
    """
    ready(docs.sparkSession)
    base = F.when(F.col("fixed"), F.col("start"))
    joined = lambda x: F.array_join(F.array_sort(F.collect_set(x)), ",")  # noqa: E731  no more than there are labels
    found = scan(docs).groupBy(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).agg(
        F.count(base).alias("n_base"), F.min(base).alias("first_word"), F.max(base).alias("last_word"),
        joined(F.when(F.col("fixed"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"), F.max("score").alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), count_words(F.col("text")).alias("n_words"))
    whole = rows.join(found, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), "left")
    return whole.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
