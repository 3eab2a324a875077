"""What the two classifiers share: hashed words, labelled rows, and a logistic scale for scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .decontaminate import small_letters
from .texts import BLANK, mix, raw, ready, remainder, small_or_plain, spans
LONGEST = 20_000  # bytes of a sampled text: with the number of rows it bounds what the driver holds


def word_hashes(texts: pa.Array, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in small letters and of their first bytes, as many as ``beginnings`` say (a column each).

    Also the n + 1 bounds of the texts' words.
    """
    data, bounds = raw(texts)
    data = small_letters(data)
    starts, ends, firsts = spans(~BLANK[data], bounds)
    if not len(starts):
        return np.zeros((0, 1 + len(beginnings)), np.uint64), firsts
    lengths = ends - starts
    within = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    own = data[~BLANK[data]].astype(np.uint64) + np.uint64(1)
    powers = mix(np.arange(4096)) | np.uint64(1)
    with np.errstate(over="ignore"):
        own = own * powers[within % 4096]
    begin = np.cumsum(lengths) - lengths
    parts = [np.add.reduceat(own, begin)]
    for size in beginnings:
        parts.append(np.add.reduceat(np.where(within < size, own, np.uint64(0)), begin) + np.uint64(size))
    return np.stack([mix(x) for x in parts], axis=1), firsts


def buckets(texts: pa.Array, words: int, rest: int, beginnings: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of each word and of its beginnings, and the bounds of the texts' words.

    Words have the first ``words`` buckets, beginnings of all lengths share the next ``rest``.
    """
    found, bounds = word_hashes(texts, beginnings)
    numbers = words + found % np.uint64(rest)
    numbers[:, 0] = found[:, 0] % np.uint64(words)
    return numbers.astype(np.int32), bounds


def sample(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], most: int, extra: list[str]) -> pd.DataFrame:
    """At most ``most`` labelled rows: those whose ids have the lowest hashes, less those of texts over ``LONGEST`` bytes.

    Rows held out, (modulus, remainder) of the id's CRC-32, and rows without a label or an id are not taken; labels of a
    repeated id count once, the larger one. The ids are chosen before any text is read.
    """
    ready(docs.sparkSession)
    modulus, rest = held_out
    told = labels.where((remainder(F.col("doc_id"), modulus) != rest) & F.col(label).isNotNull())
    # The hash includes no label, so the sample has the classes as they occur.
    chosen = told.groupBy("doc_id").agg(F.max(label).alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    own = docs.select("doc_id", "text", *extra).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= LONGEST)
    rows = own.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])  # ``most`` rows of two numbers
    return rows.toPandas().sort_values("doc_id", kind="stable")


def labelled(docs: DataFrame, labels: DataFrame, label: str, held_out: tuple[int, int], extra: list[str]) -> DataFrame:
    """``doc_id, text, label`` and ``extra`` of all labelled rows, texts of any length; which rows count is as for ``sample``."""
    ready(docs.sparkSession)
    modulus, rest = held_out
    told = labels.where((remainder(F.col("doc_id"), modulus) != rest) & F.col(label).isNotNull())
    told = small_or_plain(told.groupBy("doc_id").agg(F.max(label).alias("label")), "labelled-ids")
    return docs.select("doc_id", "text", *extra).join(told, "doc_id").dropDuplicates(["doc_id"])


def logistic(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def fit_scale(margin: np.ndarray, label: np.ndarray, rows: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and offset that make a margin a probability: logistic regression by Newton steps, slightly shrunk.

    ``rows`` tells how many rows an entry stands for, one by default.
    """
    slope, offset = 1.0, 0.0
    if not len(label) or label.min() == label.max():
        return slope, offset
    rows = np.ones(len(label)) if rows is None else rows
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    weight = np.array([slope, offset])
    for _ in range(30):
        p = logistic(x @ weight)
        gradient = x.T @ (rows * (p - label)) + 0.1 * (weight - [1.0, 0.0])
        weight = weight - np.linalg.solve((x * (rows * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2), gradient)
    return float(max(weight[0], 0.05)), float(weight[1])
