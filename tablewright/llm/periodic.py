"""Stretches of words that repeat with a period, found by lags and by minimizers of several scales.

A run is a maximal stretch whose words recur ``q`` places further on, at least twice. Short periods are read off by
comparing the words with themselves at each lag. For periods from W to 2 W - 1, W doubling from scale to scale, a run
holds a window of W words twice, ``q`` apart, and both have the same least hash of W / 2 words. Places with equal least
hashes that far apart are extended to both sides. Hashes of stretches that are periodic themselves are left out, so a
hash recurs at most four times in W places and the pairs stay in proportion to the words; a run that has no other
window lies in two touching runs of one short period, and these are looked up as such.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from .texts import BLANK, codes, mix, on_texts, raw, ready, spans

SHORTEST = 12  # words of a run
LAGS = 31  # periods up to it are found by comparing at every lag
NEVER = np.uint64((1 << 64) - 1)


def powers(base: int, count: int) -> np.ndarray:
    """The first powers of an odd number, in 64 bits."""
    factors = np.full(count, base, np.uint64)
    factors[0] = 1
    with np.errstate(over="ignore"):
        return np.cumprod(factors, dtype=np.uint64)


class Words:
    """Numbers of the words of some texts, each text followed by a number of its own, with sums that give the hash of any stretch."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, numbers: np.ndarray) -> None:
        self.of, n = numbers, len(numbers)
        with np.errstate(over="ignore"):
            self.power = powers(self.BASE, n + 1)
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(numbers) * self.power[:-1])])

    def hashes(self, length: int) -> np.ndarray:
        """Of all stretches of ``length`` words, equal for equal words."""
        n = len(self.of) - length + 1
        with np.errstate(over="ignore"):
            return mix((self.sums[length:] - self.sums[:n]) * powers(pow(self.BASE, -1, 1 << 64), n))

    def agree(self, at: np.ndarray, lag: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Whether ``length`` words from ``at`` on have the hash of those ``lag`` places on."""
        with np.errstate(over="ignore"):
            here = (self.sums[at + length] - self.sums[at]) * self.power[lag]
            return here == self.sums[at + lag + length] - self.sums[at + lag]

    def same(self, at: np.ndarray, lag: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many words from ``at`` on, or before it, are the words ``lag`` places on; ``most`` at most."""
        low, high = np.zeros_like(at), most.copy()
        while (open_ := low < high).any():
            middle = (low + high + 1) // 2
            fits = self.agree(at - middle if back else at, lag, middle)
            low = np.where(open_ & fits, middle, low)
            high = np.where(open_ & ~fits, middle - 1, high)
        return low


def stretches(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of set flags."""
    padded = np.zeros(len(flags) + 2, np.int8)
    padded[1:-1] = flags
    edges = np.flatnonzero(padded[1:] != padded[:-1])
    return edges[::2], edges[1::2]


def at_lag(numbers: np.ndarray, lag: int) -> np.ndarray:
    """Rows of start, end and period: the stretches of period ``lag``, that have two periods and the shortest length."""
    start, end = stretches(numbers[:-lag] == numbers[lag:])
    long = end - start >= max(SHORTEST - lag, lag)
    return np.stack([start[long], end[long] + lag, np.full(long.sum(), lag)], 1)


def spread(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from ``low`` up to ``high``, and which interval each comes from."""
    many = np.maximum(high - low, 0)
    which = np.repeat(np.arange(len(low)), many)
    return np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + low[which], which


def sliding(values: np.ndarray, width: int, choose) -> np.ndarray:
    """``choose`` (minimum or maximum) over every window of ``width`` values, by windows of doubled width."""
    done = 1
    while done < width:
        step = min(done, width - done)
        values = choose(values[:-step], values[step:])
        done += step
    return values


def minimizer_pairs(words: Words, gaps: np.ndarray, known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags from ``scale`` to below its double at which equal least hashes of the scale's windows stand."""
    size = scale // 2
    values = words.hashes(size)
    periodic = known[(known[:, 2] <= (size - 1) // 2) & (known[:, 1] - known[:, 0] >= size)]
    steps = np.zeros(len(values) + 1, np.int64)
    np.add.at(steps, periodic[:, 0], 1)
    np.add.at(steps, periodic[:, 1] - size + 1, -1)
    values[(np.cumsum(steps)[:-1] > 0) | (gaps[size:] > gaps[:-size])] = NEVER
    width = scale - size + 1
    least = sliding(values, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    chosen = np.flatnonzero((values == sliding(np.concatenate([edge, least, edge]), width, np.maximum)) & (values != NEVER))
    order = chosen[np.argsort(values[chosen], kind="stable")]  # equal values ascend by place
    of, found, step = values[order], [], 1
    while step < len(order):
        lag = order[step:] - order[:-step]
        near = (of[step:] == of[:-step]) & (lag < 2 * scale)
        if not near.any():
            break
        near &= lag >= scale
        found.append(np.stack([order[:-step][near], lag[near]]))
        step += 1
    place, lag = np.concatenate([np.zeros((2, 0), np.int64), *found], 1)
    return place, lag


def touching_pairs(known: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and lags at which a run of a short period may recur in the next run of that period, where the two touch."""
    short = known[(known[:, 2] <= (scale // 2 - 1) // 2) & (known[:, 1] - known[:, 0] >= scale)]
    short = short[np.lexsort((short[:, 0], short[:, 2]))]
    a, b = short[:-1], short[1:]
    touch = (a[:, 2] == b[:, 2]) & (b[:, 0] <= a[:, 1])
    a, b = a[touch], b[touch]
    most = np.minimum(a[:, 1] - a[:, 0], b[:, 1] - b[:, 0])
    lag, which = spread(np.full(len(a), scale), np.minimum(most + 1, 2 * scale))
    place = np.maximum(a[which, 0], b[which, 0] - lag)
    inside = place < a[which, 1]
    return place[inside], lag[inside]


def extended(words: Words, bounds: np.ndarray, place: np.ndarray, lag: np.ndarray) -> np.ndarray:
    """Rows of start, end and period: the runs around places whose words stand again ``lag`` places on."""
    text = np.searchsorted(bounds, place, "right") - 1
    whole = place + lag < bounds[text + 1]  # both places in one text
    place, lag, text = place[whole], lag[whole], text[whole]
    ahead = words.same(place, lag, bounds[text + 1] - place - lag)
    start = place - words.same(place, lag, place - bounds[text], back=True)
    rows = np.stack([start, place + ahead + lag, lag], 1)
    rows = first_of_each(rows[rows[:, 1] - rows[:, 0] >= 2 * lag])
    # Hashes may agree by chance: every word is compared, and a lag at which one differs is read in full.
    at, which = spread(rows[:, 0], rows[:, 1] - rows[:, 2])
    wrong = np.unique(rows[which[words.of[at] != words.of[at + rows[which, 2]]], 2])
    return np.concatenate([rows[~np.isin(rows[:, 2], wrong)], *(at_lag(words.of, int(q)) for q in wrong)])


def first_of_each(rows: np.ndarray) -> np.ndarray:
    """Of rows with the same start and end that of the smallest period: the others are its multiples."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, :2] != rows[:-1, :2]).any(1)
    return rows[new]


def all_runs(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows of start, end and smallest period of every run, by start and period.

    ``numbers`` are the words of the texts between ``bounds``; the last place of each text holds a number that no other has.
    """
    longest = int(np.diff(bounds).max(initial=0))
    known = first_of_each(np.concatenate([np.zeros((0, 3), np.int64), *(at_lag(numbers, q) for q in range(1, min(LAGS, longest // 2) + 1))]))
    scale = LAGS + 1
    if 2 * scale < longest:
        words, gaps = Words(numbers), np.zeros(len(numbers) + 1, np.int64)
        gaps[bounds[1:]] = 1
        gaps = np.cumsum(gaps)
    while 2 * scale < longest:
        seeds = [np.concatenate(x) for x in zip(minimizer_pairs(words, gaps, known, scale), touching_pairs(known, scale))]
        known = first_of_each(np.concatenate([known, extended(words, bounds, *seeds)]))
        scale *= 2
    return known[np.lexsort((known[:, 2], known[:, 0]))]


def runs_of_texts(texts: pa.Array) -> pa.Array:
    data, bounds = raw(texts)
    data, bounds = np.insert(data, bounds[1:], 0x20), bounds + np.arange(len(bounds))
    inside = ~BLANK[data]
    starts, ends, firsts = spans(inside, bounds)
    number, distinct = codes(data, inside, starts, ends)
    places = firsts + np.arange(len(firsts))  # a text's words, then a number of its own
    numbers = np.insert(number, firsts[1:], -1 - np.arange(len(texts)))
    rows = all_runs(numbers, places)
    text = np.searchsorted(places, rows[:, 0], "right") - 1
    steps = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(steps, rows[:, 0] + rows[:, 2], 1)
    np.add.at(steps, rows[:, 1], -1)
    repeats = np.cumsum(steps)[:-1] > 0
    kept = ~np.delete(repeats, places[1:] - 1)
    at = np.zeros(len(kept) + 1, np.int64)
    np.cumsum(kept, out=at[1:])
    words = pa.LargeListArray.from_arrays(pa.array(at[firsts]), distinct.cast(pa.large_string()).take(pa.array(number[kept])))
    of_text = np.searchsorted(text, np.arange(len(texts) + 1)).astype(np.int32)
    fields = [rows[:, 0] - places[text], rows[:, 1] - rows[:, 0], rows[:, 2]]
    runs = pa.ListArray.from_arrays(pa.array(of_text), pa.StructArray.from_arrays([pa.array(x) for x in fields], ["start", "length", "period"]))
    collapsed = pc.binary_join(words, pa.scalar(" ", pa.large_string())).cast(pa.string())
    return pa.StructArray.from_arrays([pa.array(np.diff(firsts)), runs, collapsed], ["n_words", "runs", "collapsed"])


def find(docs: DataFrame) -> DataFrame:
    """Add ``n_words``, ``runs`` (array of start, length and period in words) and ``collapsed`` to the rows of ``docs``.

    ``runs`` are all runs of at least 12 words and two periods, by start and period, with their smallest period. In
    ``collapsed`` each run has its first period only; the words kept are joined by single spaces. A null text and a text
    without words have no words, no runs and an empty ``collapsed``; repeated rows are treated alike; columns of these
    three names are replaced.
    """
    ready(docs.sparkSession)
    kind = "struct<n_words long, runs array<struct<start long, length long, period long>>, collapsed string>"
    found = docs.withColumn("__periodic", on_texts(lambda: runs_of_texts, kind)(F.col("text")))
    return found.withColumns({x: F.col(f"__periodic.{x}") for x in ("n_words", "runs", "collapsed")}).drop("__periodic")


def summary(found: DataFrame) -> DataFrame:
    """The result row of each document: its number of runs, the longest one, and digests of all runs and of the collapsed text."""
    length_first = F.transform("runs", lambda r: F.struct((-r["length"]).alias("minus"), r["start"].alias("start"), r["period"].alias("period")))
    best = F.array_min(length_first)
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    lines = F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), lines.alias("lines"), "collapsed")
    length = -F.col("best.minus")
    return rows.select(
        "doc_id", "n_runs", F.col("best.start").alias("start"), length.alias("length"), F.col("best.period").alias("period"),
        F.floor(1000 * length / F.col("best.period")).alias("exponent_milli"), F.sha2("lines", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


WORD = re.compile("[^\x20\x09-\x0D]+")


def with_tails(docs: DataFrame) -> DataFrame:
    """``docs`` with a periodic tail in place of the end of every tenth text, told by crc32 of the id."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))

    def run(chosen: pa.Array, texts: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        for i, h in enumerate(chosen.to_pylist()):
            words = WORD.findall(out[i] or "") if h is not None and h % 10 == 0 else []
            if words:
                n, g = len(words), h // 10
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                tail = words[a : a + p]
                out[i] = " ".join(words[:a] + (tail * ((n - a) // p + 1))[: n - a])
        return pa.array(out, texts.type)

    def tail(text: Column) -> Column:
        run.__annotations__ = {"chosen": pa.Array, "texts": pa.Array, "return": pa.Array}
        return F.arrow_udf(run, "string")(h, text)

    ready(docs.sparkSession)
    return docs.withColumn("text", tail(F.col("text")))
