"""Toxicity: a convolutional text classifier with hashed word embeddings, filters over one to three words, and max pooling.

It learns from all labelled rows. These are dealt over shards of bounded size; in each round the tasks go once through
the shards, each from the common model, and the changes of every number are averaged over the shards that changed it.
A word's embedding is the sum of those of its bucket and of the buckets of its beginnings. Scores know nothing of the
language; a threshold for each language is calibrated on rows that were kept out of the training.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .labelled import buckets, fit_scale, labelled, logistic
from .texts import on_texts, ready, release, slices

WORDS, BEGINNINGS = 1 << 16, 1 << 16
STARTS = (4, 5, 6, 7)  # bytes of a word's beginning that are hashed as well
PAD = WORDS + BEGINNINGS  # stands after a text, so that every filter has a place to look at
SIZE, FILTERS, WIDTHS = 8, 8, (1, 2, 3)
ROUNDS, BATCH, STEP = 4, 64, 0.05
BATCH_WORDS = 100_000  # of a batch, but for a single longer text
SHARD_BYTES = 16 << 20  # of texts that one task holds
APART = 5  # one row in so many tells the scale and the thresholds
UNIT = 1 << 32  # changes are summed as whole numbers, so that their order does not count
BINS = 256  # of a margin's unit, in which rows set apart are counted
HELD_OUT = (3, 1)


def padded(pairs: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two empty words after each text."""
    after = np.repeat(bounds[1:], max(WIDTHS) - 1)
    return np.insert(pairs, after, PAD, axis=0), bounds + (max(WIDTHS) - 1) * np.arange(len(bounds))


@dataclass
class Model:
    embeddings: np.ndarray  # of each bucket; the last row, of the empty word, is zero
    filters: dict[int, np.ndarray]  # by width: width, SIZE, FILTERS
    shifts: np.ndarray
    output: np.ndarray
    bias: float
    slope: float = 1.0
    offset: float = 0.0
    thresholds: dict[str, float] = field(default_factory=dict)

    def words(self, pairs: np.ndarray) -> np.ndarray:
        total = self.embeddings[pairs[..., 0]]
        for i in range(1, pairs.shape[-1]):
            total = total + self.embeddings[pairs[..., i]]
        return total

    def responses(self, pairs: np.ndarray) -> dict[int, np.ndarray]:
        """Of each width's filters at each place; the last places of a text look at empty words."""
        words = self.words(pairs)
        out = {}
        for width, weight in self.filters.items():
            total = words @ weight[0]
            for tap in range(1, width):
                total[:-tap] += words[tap:] @ weight[tap]
            out[width] = total
        return out

    def margin(self, pooled: np.ndarray) -> np.ndarray:
        return np.maximum(pooled + self.shifts, 0) @ self.output + self.bias

    def score(self, pairs: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Of texts with their empty words. The last two places of a text never win unless it has no others to look from."""
        found = [np.maximum.reduceat(self.hidden_ends(r, bounds, width), bounds[:-1], axis=0) for width, r in self.responses(pairs).items()]
        return logistic(self.slope * self.margin(np.concatenate(found, axis=1)) + self.offset)

    def hidden_ends(self, response: np.ndarray, bounds: np.ndarray, width: int) -> np.ndarray:
        """A filter must not reach over a text's end: of the places with empty words the first ``max - width`` + 1 stay."""
        for back in range(1, width):
            response[bounds[1:] - back] = -np.inf
        return response


def starting_model(counts: np.ndarray, total: np.ndarray, random: np.random.Generator) -> Model:
    """Random but for one component of the embeddings, which has how much more often a bucket's words stand in toxic texts.

    ``counts`` has the texts of either class with a bucket's words, ``total`` all texts of the class.
    """
    ratio = (total[0] + 1) / (total[1] + 1)  # the same share of either class is added to the counts
    odds = np.log((counts[1] + 0.2) / (total[1] + 0.4)) - np.log((counts[0] + 0.2 * ratio) / (total[0] + 0.4 * ratio))
    embeddings = random.normal(0, 0.05, (PAD + 1, SIZE)).astype(np.float32)
    embeddings[:, 0] = np.where(counts.sum(0) > 0, np.clip(odds, -3, 5), 0) / 4
    embeddings[PAD] = 0
    filters = {w: random.normal(0, 0.15, (w, SIZE, FILTERS)).astype(np.float32) for w in WIDTHS}
    for weight in filters.values():
        weight[:, 0, : FILTERS // 2] += 1 / len(weight)
    size = FILTERS * len(WIDTHS)
    return Model(embeddings, filters, np.full(size, -0.3, np.float32), random.normal(0.3, 0.1, size).astype(np.float32), -1.0)


def fresh(model: Model) -> Model:
    """Sums of squared gradients before the first step, in the model's own shape."""
    small = lambda x: np.full(x.shape, 1e-2, np.float32)
    return Model(small(model.embeddings), {w: small(x) for w, x in model.filters.items()}, small(model.shifts), small(model.output), 1e-2)


def flat(model: Model) -> np.ndarray:
    """All numbers of a model, ``SIZE`` a row: the embeddings, then all else."""
    rest = np.concatenate([*[x.ravel() for x in model.filters.values()], model.shifts, model.output, [model.bias]])
    return np.concatenate([model.embeddings, np.resize(np.append(rest, np.zeros(-len(rest) % SIZE)), (-(-len(rest) // SIZE), SIZE))]).astype(np.float64)


def shaped(numbers: np.ndarray) -> Model:
    """The model of ``flat`` numbers."""
    rest, at, filters = numbers[PAD + 1 :].ravel().astype(np.float32), 0, {}
    for w in WIDTHS:
        filters[w], at = rest[at : at + w * SIZE * FILTERS].reshape(w, SIZE, FILTERS).copy(), at + w * SIZE * FILTERS
    size = FILTERS * len(WIDTHS)
    return Model(numbers[: PAD + 1].astype(np.float32), filters, rest[at : at + size].copy(), rest[at + size : at + 2 * size].copy(), float(rest[at + 2 * size]))


def batched(rows: list[np.ndarray], order: np.ndarray):
    """``order`` in parts of at most ``BATCH`` rows, with ``BATCH_WORDS`` words or one row."""
    own, words = [], 0
    for i in order:
        if own and (len(own) == BATCH or words + len(rows[i]) > BATCH_WORDS):
            yield np.array(own)
            own, words = [], 0
        own.append(i)
        words += len(rows[i])
    if own:
        yield np.array(own)


def epoch(model: Model, seen: Model, rows: list[np.ndarray], label: np.ndarray, balance: np.ndarray, random: np.random.Generator) -> None:
    """One pass over the rows: logistic loss by batches, with steps scaled by past gradients. Changes ``model`` and ``seen``."""
    for own in batched(rows, random.permutation(len(rows))):
        bounds = np.concatenate([[0], np.cumsum([len(rows[i]) for i in own])])
        pairs, bounds = padded(np.concatenate([rows[i] for i in own]), bounds)
        places, pooled = [], []
        for width, response in model.responses(pairs).items():
            response = model.hidden_ends(response, bounds, width)
            place = np.stack([a + response[a:b].argmax(0) for a, b in zip(bounds, bounds[1:])])
            places.append(place)
            pooled.append(np.take_along_axis(response, place, 0))
        pooled = np.concatenate(pooled, axis=1)
        hidden = np.maximum(pooled + model.shifts, 0)
        wrong = balance[own] * (logistic(hidden @ model.output + model.bias) - label[own]) / len(own)
        back = (wrong[:, None] * model.output) * (hidden > 0)
        numbers, parts, steps = [], [], {}
        for k, (width, weight) in enumerate(model.filters.items()):
            mine = back[:, k * FILTERS : (k + 1) * FILTERS]
            slope = np.zeros_like(weight)
            for tap in range(width):
                at = np.minimum(places[k] + tap, len(pairs) - 1)
                word = model.words(pairs[at])
                slope[tap] = np.einsum("bf,bfs->sf", mine, word)
                toward = mine[:, :, None] * weight[tap].T[None]
                for side in range(pairs.shape[1]):
                    numbers.append(pairs[at, side].ravel())
                    parts.append(toward.reshape(-1, SIZE))
            steps[width] = slope
        number, place = np.unique(np.concatenate(numbers), return_inverse=True)
        moved = np.zeros((len(number), SIZE), np.float32)
        np.add.at(moved, place, np.concatenate(parts))
        seen.embeddings[number] += moved**2
        model.embeddings[number] -= STEP * moved / np.sqrt(seen.embeddings[number])
        model.embeddings[PAD] = 0
        for width, slope in steps.items():
            seen.filters[width] += slope**2
            model.filters[width] -= (STEP * slope / np.sqrt(seen.filters[width])).astype(np.float32)
        changes = []
        for past, gradient in ((seen.output, wrong @ hidden), (seen.shifts, back.sum(0))):
            past += (gradient**2).astype(np.float32)
            changes.append((STEP * gradient / np.sqrt(past)).astype(np.float32))
        model.output -= changes[0]
        model.shifts -= changes[1]
        seen.bias += float(wrong.sum()) ** 2
        model.bias -= STEP * float(wrong.sum()) / seen.bias**0.5


def word_buckets(texts: pa.Array) -> list[np.ndarray]:
    """Buckets of each text, a row a word."""
    out: list[np.ndarray] = []
    for part in slices(texts):
        numbers, bounds = buckets(part, WORDS, BEGINNINGS, STARTS)
        out += [numbers[a:b] for a, b in zip(bounds, bounds[1:])]
    return out


def bucket_counts(rows: DataFrame) -> np.ndarray:
    """Texts of either class that have a bucket's words."""

    def count(batches):
        total = np.zeros((2, PAD), np.int64)
        for batch in batches:
            for pairs, own in zip(word_buckets(batch.column("text")), batch.column("label").to_numpy(zero_copy_only=False)):
                total[int(own), np.unique(pairs)] += 1
        release()
        own, number = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(number), pa.array(total[own, number])], ["own", "number", "n"])

    found = rows.select("text", "label").mapInArrow(count, "own long, number long, n long").groupBy("own", "number").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((2, PAD + 1))
    counts[found.own, found.number] = found.n  # two numbers a bucket, however many the rows
    return counts


def trained(shards: DataFrame, model: Model, share: float, seed: int) -> Model:
    """``ROUNDS`` passes over the ``shards`` (``shard``, ``rows``), with a common model after each; ``share`` is that of toxic rows."""
    now = np.concatenate([flat(model), flat(fresh(model))], axis=1)
    names = [f"c{i}" for i in range(now.shape[1])]
    for turn in range(ROUNDS):

        def learn_shard(batches, start=now, turn=turn):
            for batch in batches:
                for shard, own in zip(batch.column("shard").to_pylist(), range(batch.num_rows)):
                    told = batch.column("rows")[own].values
                    label = told.field("label").to_numpy(zero_copy_only=False).astype(float)
                    mine, seen = shaped(start[:, :SIZE]), shaped(start[:, SIZE:])
                    balance = np.where(label > 0, 0.5 / share, 0.5 / (1 - share))
                    epoch(mine, seen, word_buckets(told.field("text")), label, balance, np.random.default_rng([seed, turn, shard]))
                    change = np.rint((np.concatenate([flat(mine), flat(seen)], axis=1) - start.astype(np.float32)) * UNIT).astype(np.int64)
                    moved = np.flatnonzero(change.any(1))
                    yield pa.RecordBatch.from_arrays([pa.array(moved), *map(pa.array, change[moved].T)], ["number", *names])
                release()

        changes = shards.mapInArrow(learn_shard, ", ".join(f"{c} long" for c in ["number", *names]))
        # As many rows as the model has, however many the shards are.
        summed = changes.groupBy("number").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in names]).toPandas()
        now = now.copy()
        now[summed.number] += summed[names].to_numpy() / UNIT / summed.n.to_numpy()[:, None]
    return shaped(now[:, :SIZE])


def train(rows: DataFrame, seed: int = 11) -> Model:
    """Model of all ``rows`` (``doc_id, text, label, lang``): training on most, then the scale of scores and the thresholds on rows set apart."""
    random = np.random.default_rng(seed)
    rows = stage(rows.withColumn("apart", F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(APART)) == 0), "toxicity-rows")
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("size")
    facts = {(r["apart"], int(r["label"])): r for r in rows.groupBy("apart", "label").agg(F.count("*").alias("n"), size).collect()}
    total = np.array([sum(r["n"] for (_, own), r in facts.items() if own == label) for label in (0, 1)], float)
    if not total.all():
        model = starting_model(np.zeros((2, PAD + 1)), np.zeros(2), random)
        model.output[:], model.bias = 0, (4.0 if total[1] else -4.0)
        return model
    learned = rows.where("not apart")
    of_learned = np.array([facts[False, label]["n"] if (False, label) in facts else 0 for label in (0, 1)], float)
    model = starting_model(bucket_counts(learned), of_learned, random)
    count = max(1, -(-sum(r["size"] for (apart, _), r in facts.items() if not apart) // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("doc_id", F.lit(seed + 1)), F.lit(count)).cast("int").alias("shard")
    dealt = learned.groupBy(shard).agg(F.sort_array(F.collect_list(F.struct("doc_id", "label", F.coalesce("text", F.lit("")).alias("text")))).alias("rows"))
    model = trained(stage(dealt, "toxicity-shards"), model, total[1] / total.sum(), seed)
    raw = F.least(F.greatest(score(F.col("text"), model), F.lit(1e-9)), F.lit(1 - 1e-9))
    kept = rows.where("apart").select("lang", "label", raw.alias("raw"))
    kept = kept.groupBy("lang", "label", F.round(F.log(F.col("raw") / (1 - F.col("raw"))) * BINS).alias("bin")).agg(F.count("*").alias("n")).toPandas()
    kept = kept.sort_values(["bin", "label", "lang"], kind="stable")  # as many as languages and bins
    label, n = kept.label.to_numpy(float), kept.n.to_numpy(float)
    if n.sum() > 20 and label.min() != label.max():
        margin = kept.bin.to_numpy(float) / BINS
        model.slope, model.offset = fit_scale(margin, label, n)
        model.thresholds = calibrate(logistic(model.slope * margin + model.offset), label, kept.lang.tolist(), n)
    return model


def calibrate(scores: np.ndarray, label: np.ndarray, languages: list, rows: np.ndarray, default: float = 0.5) -> dict[str, float]:
    """For each language the threshold of the best F1; languages with fewer than five toxic rows share that of all rows.

    ``rows`` tells how many rows an entry stands for.
    """

    def best(own: np.ndarray) -> float:
        score, place = np.unique(-scores[own], return_inverse=True)
        hits, taken = (np.cumsum(np.bincount(place, w, len(score))) for w in (rows[own] * label[own], rows[own]))
        i = int((2 * hits / (taken + max(1, hits[-1]))).argmax())
        return float((-score[i] + (-score[i + 1] if i + 1 < len(score) else 0.0)) / 2)

    every = np.arange(len(label))
    common = best(every) if label.sum() else default
    found = {"": common}
    for name in sorted({x for x in languages if x is not None}):
        own = every[[x == name for x in languages]]
        found[name] = best(own) if (rows[own] * label[own]).sum() >= 5 else common
    return found


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Model of ``labels.toxic`` from all labelled rows that are not held out, whole texts.

    ``lang`` is read only to calibrate the thresholds. Without rows, or with rows of one class, all scores are alike.
    """
    return train(labelled(docs, labels, "toxic", HELD_OUT, ["lang"]))


def score(text: Column, model: Model) -> Column:
    """Score of a whole text, 0 to 1; a null or empty text has that of no word at all."""

    def one(texts: pa.Array) -> pa.Array:
        if not len(texts):
            return pa.array(np.zeros(0))
        return pa.array(model.score(*padded(*buckets(texts, WORDS, BEGINNINGS, STARTS))).astype(float))

    return on_texts(lambda: one, "double")(text)


def judge(docs: DataFrame, model: Model, least: float = 0.7) -> DataFrame:
    """Add ``score``, ``predicted`` (by ``least``) and ``toxic_by_language`` (by the row's language's own threshold).

    Rows of a language without a threshold, or of none, take the one of all rows. Columns of these names are replaced.
    """
    ready(docs.sparkSession)
    limits = model.thresholds or {"": least}
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    scored = docs.withColumn("score", score(F.col("text"), model)).withColumn("predicted", (F.col("score") >= least).cast("int"))
    own = F.coalesce(table[F.coalesce(F.col("lang"), F.lit(""))], F.lit(limits[""]))
    return scored.withColumn("toxic_by_language", (F.col("score") >= own).cast("int"))
