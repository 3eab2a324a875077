"""Whole texts as byte arrays: what the Arrow functions of this package share."""

from __future__ import annotations

import ctypes
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import stage

SLICE_BYTES = 1 << 20  # texts handled at a time; one longer text is handled alone
BATCH_BYTES = 4 << 20  # Arrow batches between the JVM and Python, so that two tasks of long texts fit in a small executor
BROADCAST_ROWS = 100_000

BLANK = np.zeros(256, bool)
BLANK[[0x20, *range(0x09, 0x0E)]] = True


def ready(spark: SparkSession) -> None:
    """Let Python workers import this package when it is not on their path, and keep Arrow batches small.

    The batch size is a setting of the session; a smaller one is left as it is.
    """
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not 0 < byte_size(spark.conf.get(size)) <= BATCH_BYTES:
        spark.conf.set(size, f"{BATCH_BYTES}b")


def byte_size(text: str) -> int:
    """Bytes of a size as settings spell it: a whole number and perhaps a unit, such as 64m, 4kb or 1048576b."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]*)\s*", text.lower()).groups()
    return int(number) << 10 * "bkmgtp".index(unit[:1] or "b")


def characters() -> Iterator[tuple[int, str]]:
    """All code points in order, in parts with the first one's number; an exclamation mark stands for each surrogate."""
    for start in range(0, 0x110000, 0x4000):
        points = np.arange(start, start + 0x4000, dtype="<u4")
        points[(points >= 0xD800) & (points < 0xE000)] = 0x21
        yield start, points.tobytes().decode("utf-32-le")


def release() -> None:
    """Give back memory that is free but still held by this worker: it lives on while other stages start their own."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts, one after the other, and their n + 1 bounds; a null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, bounds, data = texts.buffers()
    if bounds is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    bounds = np.frombuffer(bounds, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def slices(texts: pa.Array, most: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Parts of at most ``most`` bytes, or of one text."""
    bounds, start = raw(texts)[1], 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(bounds, bounds[start] + most, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def on_texts(work: Callable[[], Callable[[pa.Array], pa.Array]], returns: str, most: int = SLICE_BYTES):
    """Column function of texts; ``work()`` is called once a task and gives the function of a slice of texts."""

    made: list[Callable[[pa.Array], pa.Array]] = []  # empty in every task

    def run(part: pa.Array) -> pa.Array:
        if not made:
            made.append(work())
        done = [made[0](x) for x in slices(part, most)] or [made[0](part)]
        whole = done[0] if len(done) == 1 else pa.concat_arrays(done)
        release()
        return whole

    run.__annotations__ = {"part": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, returns)


def strings(data: np.ndarray, bounds: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Arrow strings over joined bytes; a slice is far below the two gigabytes that 32-bit bounds reach."""
    wide = pa.types.is_large_string(kind) or pa.types.is_large_binary(kind)
    bounds = np.ascontiguousarray(bounds, np.int64 if wide else np.int32)
    return pa.Array.from_buffers(kind, len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))])


def spans(inside: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` that stay within a text: starts, ends, and the n + 1 run numbers at the text bounds."""
    n = len(inside)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    firsts = bounds[:-1][bounds[:-1] < bounds[1:]]
    before[firsts] = False
    after[firsts[1:] - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def codes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each run's distinct content, and the contents."""
    at = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=at[1:])
    found = strings(data[inside], at, pa.large_binary()).dictionary_encode()
    return found.indices.to_numpy(zero_copy_only=False).astype(np.int64), found.dictionary


def per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """How many of ``flags`` are set in each text."""
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: spreads small numbers over all bits."""
    x = x.astype(np.uint64)
    with np.errstate(over="ignore"):
        x = (x + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``: the fixed split into learning and held-out rows."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def small_or_plain(df: DataFrame, label: str) -> DataFrame:
    """A table written once, with a broadcast hint only if it has at most ``BROADCAST_ROWS`` rows."""
    kept = stage(df, label)
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept
