"""Quality classifier: a factorisation machine over hashed words, structure statistics and the text's size.

A pair of features i, j weighs <v_i, v_j>, and all pairs are summed in linear time, since
the sum over pairs is half of (sum of v_i x_i) squared less the sum of (v_i x_i) squared.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .labelled import buckets, fit_scale, logistic, sample
from .rules import count_texts
from .texts import on_texts, per_text, raw, ready, slices

WORDS, BEGINNINGS = 1 << 15, 1 << 13
STARTS = (5,)  # bytes of a word's beginning that are hashed as well
RANK = 8
SAMPLE_ROWS = 15_000
EPOCHS, BATCH, STEP, SHRINK = 6, 64, 0.05, 1e-5
HELD_OUT = (4, 2)
STATISTICS = [
    "symbols", "repeated", "equal_lines", "word_length", "words_a_line", "capitals", "digits", "marks", "exclamations", "beyond_ascii", "few_words", "size",
]


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of ``STATISTICS`` for each text: shares between 0 and 1, or logarithms scaled to a like range."""
    data, bounds = raw(texts)
    n_words, chars, symbols, equal, repeated, lines = (x.to_numpy(zero_copy_only=False).astype(float) for x in count_texts(texts).flatten())
    share = lambda flags: per_text(flags, bounds) / np.maximum(1, np.diff(bounds))
    marks = ((data >= 0x21) & (data <= 0x2F)) | ((data >= 0x3A) & (data <= 0x40)) | ((data >= 0x5B) & (data <= 0x60)) | ((data >= 0x7B) & (data <= 0x7E))
    return np.stack([
        symbols / np.maximum(1, chars) * 4, repeated / np.maximum(1, n_words), equal / np.maximum(1, lines), np.minimum(20, chars / np.maximum(1, n_words)) / 10,
        np.log1p(n_words / np.maximum(1, lines)) / 5, share((data >= 0x41) & (data <= 0x5A)), share((data >= 0x30) & (data <= 0x39)), share(marks) * 2,
        share(data == 0x21) * 4, share(data >= 0x80), 1 / (1 + n_words / 20), np.log1p(np.diff(bounds)) / 12,
    ], axis=1).astype(np.float32)


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse rows: feature numbers, values, and the n + 1 bounds. Words are present or not, and have length one together."""
    pairs, bounds = buckets(texts, WORDS, BEGINNINGS, STARTS)
    n, total = len(texts), WORDS + BEGINNINGS
    text = np.repeat(np.arange(n, dtype=np.int64), pairs.shape[1] * np.diff(bounds))
    keys = np.unique(text * total + pairs.ravel())
    text, number = keys // total, keys % total
    size = np.bincount(text, minlength=n)
    value = 1 / np.sqrt(size[text])
    plain = statistics(texts)
    all_text = np.concatenate([text, np.repeat(np.arange(n), plain.shape[1])])
    all_number = np.concatenate([number, np.tile(total + np.arange(plain.shape[1]), n)])
    all_value = np.concatenate([value, plain.ravel()]).astype(np.float32)
    order = np.argsort(all_text, kind="stable")
    return all_number[order].astype(np.int32), all_value[order], np.concatenate([[0], np.cumsum(size + plain.shape[1])])


@dataclass
class Model:
    bias: float
    weight: np.ndarray  # of each feature
    factors: np.ndarray  # of each feature, RANK numbers
    slope: float = 1.0
    offset: float = 0.0

    def margin(self, number: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Linear part and pairs of each row; a row has the statistics at least."""
        part = self.factors[number] * value[:, None]
        summed = np.add.reduceat(part, bounds[:-1], axis=0)
        squares = np.add.reduceat(part * part, bounds[:-1], axis=0)
        return self.bias + np.add.reduceat(self.weight[number] * value, bounds[:-1]) + 0.5 * (summed * summed - squares).sum(1)

    def score(self, number: np.ndarray, value: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        return logistic(self.slope * self.margin(number, value, bounds) + self.offset)


def train(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, seed: int = 7) -> Model:
    """Logistic loss, both classes with the same total weight, steps scaled by past gradients (Adagrad)."""
    random = np.random.default_rng(seed)
    count = WORDS + BEGINNINGS + len(STATISTICS)
    model = Model(0.0, np.zeros(count, np.float32), random.normal(0, 0.01, (count, RANK)).astype(np.float32))
    if not len(label) or label.min() == label.max():
        model.bias = 4.0 * (label.mean() - 0.5) * 2 if len(label) else 0.0
        return model
    checked = random.random(len(label)) < 0.15
    learned = np.flatnonzero(~checked)
    seen_w, seen_v, seen_b = np.full(count, 1e-3, np.float32), np.full((count, RANK), 1e-3, np.float32), 1e-3
    balance = np.where(label > 0, 0.5 / max(1e-9, label.mean()), 0.5 / max(1e-9, 1 - label.mean()))
    for _ in range(EPOCHS):
        random.shuffle(learned)
        for start in range(0, len(learned), BATCH):
            own = learned[start : start + BATCH]
            number, value = np.concatenate([rows[i][0] for i in own]), np.concatenate([rows[i][1] for i in own])
            bounds = np.concatenate([[0], np.cumsum([len(rows[i][0]) for i in own])])
            wrong = (balance[own] * (logistic(model.margin(number, value, bounds)) - label[own]) / len(own)).astype(np.float32)
            each = np.repeat(np.arange(len(own)), np.diff(bounds))
            summed = np.add.reduceat(model.factors[number] * value[:, None], bounds[:-1], axis=0)
            slope = (wrong[each] * value)[:, None]
            distinct, place = np.unique(number, return_inverse=True)
            gradient_v = np.zeros((len(distinct), RANK), np.float32)
            np.add.at(gradient_v, place, slope * (summed[each] - model.factors[number] * value[:, None]))
            gradient_w = np.bincount(place, slope[:, 0], len(distinct)).astype(np.float32) + SHRINK * model.weight[distinct]
            gradient_v += SHRINK * model.factors[distinct]
            seen_w[distinct] += gradient_w**2
            seen_v[distinct] += gradient_v**2
            model.weight[distinct] -= STEP * gradient_w / np.sqrt(seen_w[distinct])
            model.factors[distinct] -= STEP * gradient_v / np.sqrt(seen_v[distinct])
            seen_b += float(wrong.sum()) ** 2
            model.bias -= STEP * float(wrong.sum()) / seen_b**0.5
    kept = np.flatnonzero(checked)
    if len(kept) > 20 and label[kept].min() != label[kept].max():
        margin = np.array([model.margin(*rows[i], np.array([0, len(rows[i][0])]))[0] for i in kept])
        model.slope, model.offset = fit_scale(margin, label[kept])
    return model


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE_ROWS) -> Model:
    """Model of ``labels.quality`` from at most ``most`` labelled rows that are not held out.

    Without rows every score is 0.5; with rows of one class all scores are near that class.
    """

    rows, told = sample(docs, labels, "quality", HELD_OUT, most, []), []
    for part in slices(pa.array(rows.pop("text"), pa.string())):
        number, value, bounds = features(part)
        told += [(number[a:b], value[a:b]) for a, b in zip(bounds, bounds[1:])]
    return train(told, rows.label.to_numpy(float))


def score(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1; a null or empty text is scored by its statistics alone."""

    def one(texts: pa.Array) -> pa.Array:
        return pa.array(model.score(*features(texts)).astype(float) if len(texts) else np.zeros(0))

    return on_texts(lambda: one, "double")(text)


def judge(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """Add ``score`` and ``predicted`` for every row, repeated ones included; columns of these names are replaced."""
    ready(docs.sparkSession)
    return docs.withColumn("score", score(F.col("text"), model)).withColumn("predicted", (F.col("score") >= least).cast("int"))
