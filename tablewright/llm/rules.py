"""Quality rules whose limits follow the data: quantile sketches per language and source, merged where a group is small.

A sketch is a table of counts by logarithmic bucket (relative error 2 %). Counts add up, so
sketches of parts of the data, of sources and of languages merge exactly, in any order, and
the same rows always give the same limits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage
from .texts import BLANK, codes, mix, on_texts, per_text, raw, ready, small_or_plain, spans

WINDOW = 8
MIN_WORDS = 20
MAX_REPEATED = 30  # percent of the words
SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True

BUCKET = 1.02  # ratio of neighbouring bucket bounds
MIN_ROWS = 200  # smaller groups take the limits of their language, then those of all documents
REACH = 4.0  # fences lie this many quartile distances beyond the quartiles

# name: (numerator, denominator, scale, widening, rejects low values too). Metrics are whole numbers, so that equal
# documents fall into equal buckets on every machine. The widening is the least distance of a fence from its quartile.
METRICS = {
    "symbol_share": ("n_symbols", "word_chars", 1000, 50, False),
    "repeat_share": ("n_repeat_words", "n_words", 1000, 150, False),
    "dup_line_share": ("n_dup_lines", "n_lines", 1000, 300, False),
    "word_length": ("word_chars", "n_words", 100, 200, True),
}
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]


def repeated_words(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Words that lie in a window of ``WINDOW`` words found twice or more in their text. ``words``: numbers of the contents."""
    covered = np.zeros(len(words), bool)
    n = len(words) - WINDOW + 1
    if n <= 0:
        return covered
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    spread = mix(words)
    with np.errstate(over="ignore"):
        window = np.zeros(n, np.uint64)
        for i in range(WINDOW):
            window = window * np.uint64(0x9E3779B97F4A7C15) + spread[i : i + n]
        window = mix(window) ^ mix(text[:n] + (1 << 40))
    whole = np.flatnonzero(text[:n] == text[WINDOW - 1 :])
    window = window[whole]
    order = np.sort(window)
    twice = np.unique(order[1:][order[1:] == order[:-1]])
    if len(twice):
        found = whole[twice[np.minimum(np.searchsorted(twice, window), len(twice) - 1)] == window]
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, found, 1)
        np.add.at(change, found + WINDOW, -1)
        covered = np.cumsum(change[:-1]) > 0
    return covered


def duplicate_lines(data: np.ndarray, bounds: np.ndarray, has_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: lines with a word that equal an earlier line, and all lines with a word."""
    n = len(bounds) - 1
    inside = data != 0x0A
    starts, ends, firsts = spans(inside, bounds)  # empty lines have no word
    if not len(starts):
        return np.zeros(n, np.int64), np.zeros(n, np.int64)
    words = np.zeros(len(data) + 1, np.int64)
    np.cumsum(has_word, out=words[1:])
    filled = words[ends] > words[starts]
    line, distinct = codes(data, inside, starts, ends)
    text = np.repeat(np.arange(n), np.diff(firsts))
    lines = np.bincount(text[filled], minlength=n)
    different = np.unique(text[filled] * len(distinct) + line[filled]) // len(distinct)
    return lines - np.bincount(different, minlength=n), lines


def count_texts(texts: pa.Array) -> pa.Array:
    data, bounds = raw(texts)
    inside = ~BLANK[data]
    starts, ends, firsts = spans(inside, bounds)
    words, _ = codes(data, inside, starts, ends)
    duplicates, lines = duplicate_lines(data, bounds, inside)
    columns = [
        np.diff(firsts), per_text(inside & ((data & 0xC0) != 0x80), bounds), per_text(SYMBOLS[data], bounds), duplicates,
        per_text(repeated_words(words, firsts), firsts), lines,
    ]
    return pa.StructArray.from_arrays([pa.array(x.astype(np.int64)) for x in columns], COUNTS)


def counter():
    """Column function text -> struct of the counts."""
    return on_texts(lambda: count_texts, "struct<" + ", ".join(f"{c} long" for c in COUNTS) + ">")


def measure(docs: DataFrame) -> DataFrame:
    """Add the counts of the whole ``text``; columns of the same names are replaced.

    A null text, like an empty one, has no words and no lines: all counts are 0.
    """
    ready(docs.sparkSession)
    found = docs.withColumn("__counts", counter()(F.col("text")))
    return found.withColumns({c: F.col(f"__counts.{c}") for c in COUNTS}).drop("__counts")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def metric(name: str) -> Column:
    top, bottom, scale, _, _ = METRICS[name]
    return F.coalesce(F.floor(F.col(top) * scale / F.nullif(F.col(bottom), F.lit(0))), F.lit(0)).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Counts by ``lang, source, metric, bucket`` over the documents that pass the fixed rules."""
    long = measured.where(~base_failed()).select(
        "lang", "source", F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), metric(m).alias("x")) for m in METRICS]))
    )
    bucket = F.when(F.col("x") > 0, 1 + F.floor(F.log("x") / F.lit(float(np.log(BUCKET))))).otherwise(0).cast("int")
    return long.groupBy("lang", "source", "metric", bucket.alias("bucket")).agg(F.count("*").alias("rows"))


def merged(parts: DataFrame, *keys: str) -> DataFrame:
    """Sketches of coarser groups: the counts of their parts added up."""
    return parts.groupBy(*keys, "metric", "bucket").agg(F.sum("rows").alias("rows"))


def fences(parts: DataFrame, *keys: str) -> DataFrame:
    """``low`` and ``high`` limit of each group and metric from the quartiles of its sketch, and the group's rows."""
    group = Window.partitionBy(*keys, "metric")
    ranked = parts.withColumn("up_to", F.sum("rows").over(group.orderBy("bucket"))).withColumn("all", F.sum("rows").over(group))
    value = F.when(F.col("bucket") > 0, F.pow(F.lit(BUCKET), F.col("bucket") - 0.5)).otherwise(0.0)
    quartile = lambda q: F.min(F.when(F.col("up_to") >= F.ceil(F.col("all") * q), value))
    widening = F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, float(v[3]))])
    both = F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[4])])
    found = ranked.groupBy(*keys, "metric").agg(quartile(0.25).alias("q1"), quartile(0.75).alias("q3"), F.max("all").alias("all"))
    reach = F.greatest(REACH * (F.col("q3") - F.col("q1")), widening[F.col("metric")])
    return found.select(
        *keys, "metric", "all", (F.col("q3") + reach).alias("high"), F.when(both[F.col("metric")], F.col("q1") - reach).alias("low")
    )


def limits(measured: DataFrame) -> DataFrame:
    """One row per ``lang, source`` that occurs (nulls are a group of their own), with a fence for each metric.

    A group of fewer than ``MIN_ROWS`` documents takes the fences of its language's merged sketch, and a language of
    fewer those of the sketch merged over all documents.
    """
    fine = stage(sketches(measured), "rule-sketches")
    by_source, by_language, of_all = fences(fine, "lang", "source"), fences(merged(fine, "lang"), "lang"), fences(merged(fine))
    renamed = lambda df, tag: df.select(*[F.col(c).alias(c if c == "metric" else f"{tag}_{c}") for c in df.columns])
    a, b, c = renamed(by_source, "a"), renamed(by_language, "b"), renamed(of_all, "c")
    joined = a.join(b, (F.col("a_lang").eqNullSafe(F.col("b_lang"))) & (a.metric == b.metric)).drop(b.metric).join(c, "metric")
    chosen = lambda x: F.when(F.col("a_all") >= MIN_ROWS, F.col(f"a_{x}")).when(
        F.col("b_all") >= MIN_ROWS, F.col(f"b_{x}")).otherwise(F.col(f"c_{x}"))
    rows = joined.select(F.col("a_lang").alias("lang"), F.col("a_source").alias("source"), "metric", chosen("low").alias("low"), chosen("high").alias("high"))
    return rows.groupBy("lang", "source").agg(
        *[F.max(F.when(F.col("metric") == m, F.col(x))).alias(f"{m}_{x}") for m in METRICS for x in ("low", "high")]
    )


def judge(measured: DataFrame, limit: DataFrame) -> DataFrame:
    """Add ``base_failed``, ``kept`` and ``reasons`` (array of the rules broken), by a join with the limits of a row's group.

    A group without limits (all its documents fail the fixed rules) has no rows to judge beyond these.
    """
    fence = small_or_plain(limit, "rule-limits").withColumnsRenamed({"lang": "__lang", "source": "__source"})
    own = measured.withColumn("base_failed", base_failed())
    rows = own.join(fence, F.col("lang").eqNullSafe(F.col("__lang")) & F.col("source").eqNullSafe(F.col("__source")), "left")
    broken = [F.when(F.col("n_words") < MIN_WORDS, "few_words"), F.when(100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"), "repeated")]
    for m in METRICS:
        broken.append(F.when((metric(m) > F.col(f"{m}_high")) | (metric(m) < F.col(f"{m}_low")), m))
    rows = rows.withColumn("reasons", F.array_compact(F.array(*broken))).withColumn("kept", F.size("reasons") == 0)
    return rows.drop("__lang", "__source", *[f"{m}_{x}" for m in METRICS for x in ("low", "high")])


def keep(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` that pass, with their own columns. Repeated rows share their verdict; an empty table stays empty."""
    # The counts are taken twice, once for the limits and once with the rows, so that no text is shuffled or stored.
    limit = limits(measure(docs.select("text", "lang", "source")))
    ready(docs.sparkSession)
    own = {c: f"__own{i}" for i, c in enumerate(docs.columns)}
    counted = docs.toDF(*own.values()).withColumn("__counts", counter()(F.col(own["text"])))
    judged = judge(counted.select(*own.values(), "__counts.*", F.col(own["lang"]).alias("lang"), F.col(own["source"]).alias("source")), limit)
    return judged.where("kept").select(*[F.col(n).alias(c) for c, n in own.items()])
