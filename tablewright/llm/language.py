"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs. A run of three letters, the places beyond a word's
ends among them, is the product of its letters' vectors, the first permuted twice and the
second once. A text, and all texts of a language, is the sum of its runs; the language whose
sum is closest by cosine is predicted.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, functions as F

from .counts import code_points
from .texts import characters, on_texts, raw, ready, remainder, slices

DIMENSIONS = 512
LETTERS = 48  # symbols: none, a to z, and buckets for all other letters
SEED = 20_240_517
UNDETERMINED = "und"
LANGUAGES_AT_ONCE = 32  # a learning task hands over its sums when it holds more


@lru_cache(1)
def symbols() -> np.ndarray:
    """Symbol of every code point, capitals as their small letters; 0 is no letter."""
    table = np.zeros(0x110000, np.uint8)
    for start, found in ((start, x) for start, part in characters() for x in regex.finditer(r"\p{L}", part)):
        small = ord(found[0].lower()[0])
        table[start + found.start()] = small - 0x60 if 0x61 <= small <= 0x7A else 27 + small % (LETTERS - 27)
    return table


@lru_cache(1)
def vectors() -> tuple[np.ndarray, np.ndarray]:
    """Products of the first two letters of a run, by pair, and the vectors of the third."""
    signs = np.random.default_rng(SEED).integers(0, 2, (LETTERS, DIMENSIONS), dtype=np.int8) * 2 - 1
    first, second = np.roll(signs, 2, axis=1), np.roll(signs, 1, axis=1)
    return (first[:, None] * second[None]).reshape(-1, DIMENSIONS).astype(np.int8), signs.astype(np.int8)


def runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct runs of each text: numbers, how often each occurs, and the n + 1 bounds of the texts."""
    data, bounds = raw(texts)
    n = len(texts)
    data, bounds = np.insert(data, bounds[1:], 0x20), bounds + np.arange(n + 1)
    leads = np.flatnonzero((data & 0xC0) != 0x80)
    letters = symbols()[code_points(data, leads)]
    kept = np.ones(len(letters), bool)
    kept[1:] = (letters[1:] > 0) | (letters[:-1] > 0)
    text = np.searchsorted(bounds, leads[kept], "right") - 1
    s = np.concatenate([[0], letters[kept]]).astype(np.int64)
    text = np.concatenate([[0], text])
    inner = np.flatnonzero(s[1:-1] > 0) + 1
    run = (s[inner - 1] * LETTERS + s[inner]) * LETTERS + s[inner + 1]
    order = np.sort(text[inner] * LETTERS**3 + run)
    new = np.ones(len(order), bool)
    new[1:] = order[1:] != order[:-1]
    place = np.flatnonzero(new)
    return order[place] % LETTERS**3, np.diff(np.append(place, len(order))), np.searchsorted(order[place] // LETTERS**3, np.arange(n + 1))


def bundle(run: np.ndarray, times: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Sum of the runs' vectors."""
    pairs, thirds = vectors()
    total = np.zeros(DIMENSIONS, kind)
    for i in range(0, len(run), 4096):
        signs = pairs[run[i : i + 4096] // LETTERS] * thirds[run[i : i + 4096] % LETTERS]
        total += times[i : i + 4096].astype(kind) @ signs.astype(kind)
    return total


@dataclass
class Profiles:
    """Language names in ascending order and their vectors of length one."""

    names: list[str]
    vectors: np.ndarray


def learn(docs: DataFrame) -> Profiles:
    """Profiles from every row of ``lang, text`` that has a language; a null or empty text adds nothing.

    A task sums the vectors of its texts by language and hands over one row for each dimension, so what is shuffled
    and collected depends on the number of languages only. Sums are whole numbers: their order does not matter.
    """
    ready(docs.sparkSession)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}

        def hand_over() -> Iterator[pa.RecordBatch]:
            for name, counts in held.items():
                run = np.flatnonzero(counts)
                total = bundle(run, counts[run], np.float64).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([name] * DIMENSIONS), pa.array(np.arange(DIMENSIONS, dtype=np.int32)), pa.array(total)], ["lang", "dimension", "value"]
                )
            held.clear()

        for batch in batches:
            names, start = batch.column(0).to_pylist(), 0
            for part in slices(batch.column(1)):
                run, times, bounds = runs(part)
                text = np.repeat(np.arange(len(part)), np.diff(bounds))
                number, own = np.unique(np.array(names[start : start + len(part)], object), return_inverse=True)
                for i, name in enumerate(number):
                    mine = own[text] == i
                    counts = np.bincount(run[mine], times[mine], LETTERS**3).astype(np.int64)
                    held[name] = held[name] + counts if name in held else counts
                start += len(part)
                if len(held) > LANGUAGES_AT_ONCE:
                    yield from hand_over()
        yield from hand_over()

    told = docs.where(F.col("lang").isNotNull()).select("lang", "text")
    rows = told.mapInArrow(sums, "lang string, dimension int, value long").groupBy("lang", "dimension").agg(F.sum("value").alias("value")).collect()
    names = sorted({r.lang for r in rows})
    total = np.zeros((len(names), DIMENSIONS))
    for r in rows:
        total[names.index(r.lang), r.dimension] = r.value
    length = np.linalg.norm(total, axis=1, keepdims=True)
    return Profiles(names, (total / np.where(length > 0, length, 1)).astype(np.float32))


def compare(text: Column, profiles: Profiles) -> Column:
    """``struct<lang_pred string, score double>``: the closest profile and its cosine, at least 0."""

    def one(texts: pa.Array) -> pa.Array:
        run, times, bounds = runs(texts)
        found, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        for i in np.flatnonzero(np.diff(bounds)) if profiles.names else []:
            own = bundle(run[bounds[i] : bounds[i + 1]], times[bounds[i] : bounds[i + 1]])
            near = profiles.vectors @ own
            best = int(near.argmax())
            length = float(np.linalg.norm(own))
            found[i] = profiles.names[best]
            scores[i] = min(1.0, max(0.0, float(near[best]) / length)) if length else 0.0
        return pa.StructArray.from_arrays([pa.array(found, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    return on_texts(lambda: one, "struct<lang_pred string, score double>")(text)


def predict(docs: DataFrame, profiles: Profiles) -> DataFrame:
    """Add ``lang_pred`` and ``score`` for every row; columns of these names are replaced.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was learned. Of
    equally close languages the first by name is taken.
    """
    ready(docs.sparkSession)
    found = docs.withColumn("__language", compare(F.col("text"), profiles))
    return found.withColumns({"lang_pred": F.col("__language.lang_pred"), "score": F.col("__language.score")}).drop("__language")


def learning_rows(docs: DataFrame) -> DataFrame:
    """The rows that profiles are learned from; a null id is held out."""
    return docs.where(remainder(F.col("doc_id"), 3) != 1)
