"""Exact quantiles without gathering a column in one task.

The built-in exact percentile keeps every distinct value of a column in one
task. Here a sketch first finds a narrow value range that must hold the wanted
ranks, exact counts confirm it, and the range is narrowed again until few
enough values lie inside it; only those are ranked exactly. Every row takes part
in the counts, so the result is exact however good the sketch was.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .running import running_totals
from .tables import batches

SKETCH_ACCURACY = 1000
COLUMNS_PER_PASS = 8


@dataclass
class _Target:
    """Bracket [low, high] around ranks ``rank`` and ``rank + 1`` of one column."""

    slot: str
    position: float
    low: float | None = None
    high: float | None = None
    below: int = 0
    inside: int = 0
    interior: int = 0
    slack: float = 2.0 / SKETCH_ACCURACY

    @property
    def rank(self) -> int:
        return math.floor(self.position)

    @property
    def next_rank(self) -> int:
        return math.ceil(self.position)

    def within(self) -> Column:
        c = F.col(self.slot)
        return F.when(c.between(F.lit(self.low), F.lit(self.high)), c) if self.low is not None else c


def exact_quantiles(
    df: DataFrame,
    columns: dict[str, Column],
    probabilities: list[float],
    values_per_task: int = 100_000,
) -> dict[str, list[float | None]]:
    """Linear-interpolated quantiles of each column; None for a column without values."""
    result: dict[str, list[float | None]] = {}
    for names in batches(list(columns), COLUMNS_PER_PASS):
        slots = {f"q{i}": columns[n].cast("double") for i, n in enumerate(names)}
        wide = df.select(*[c.alias(s) for s, c in slots.items()])
        found = _batch_quantiles(wide, list(slots), probabilities, values_per_task)
        result.update({n: found[f"q{i}"] for i, n in enumerate(names)})
    return result


def _batch_quantiles(wide: DataFrame, slots: list[str], probabilities: list[float], limit: int) -> dict:
    counts = wide.agg(*[F.count(s).alias(s) for s in slots]).first()
    small = [s for s in slots if 0 < counts[s] <= limit]
    large = [s for s in slots if counts[s] > limit]
    out: dict[str, list[float | None]] = {s: [None] * len(probabilities) for s in slots}
    if small:
        wanted = F.array(*[F.lit(float(p)) for p in probabilities])
        row = wide.agg(*[F.percentile(s, wanted).alias(s) for s in small]).first()
        out.update({s: list(row[s]) for s in small})
    if large:
        out.update(_narrowed_quantiles(wide, large, counts, probabilities, limit))
    return out


def _narrowed_quantiles(wide: DataFrame, slots: list[str], counts, probabilities, limit: int) -> dict:
    targets = {
        (s, i): _Target(s, p * (counts[s] - 1), inside=counts[s], interior=counts[s])
        for s in slots
        for i, p in enumerate(probabilities)
    }
    for _ in range(16):
        active = [t for t in targets.values() if t.interior > limit]
        if not active:
            break
        _narrow(wide, active)
    ranks = {}
    for key, t in targets.items():
        for rank in (t.rank, t.next_rank):
            # The middle of a rank's step, so that rounding cannot move to a neighbour.
            p = (rank - t.below + 0.5) / t.inside
            ranks[key, rank] = (t, p)
    names = {k: f"r{i}" for i, k in enumerate(ranks)}
    row = _ranked(wide, [(names[k], t, p) for k, (t, p) in ranks.items()])
    out: dict[str, list[float]] = {s: [] for s in slots}
    for (s, i), t in targets.items():
        low, high = row[names[(s, i), t.rank]], row[names[(s, i), t.next_rank]]
        share = t.position - t.rank
        out[s].append(low if share == 0 else low * (1 - share) + high * share)
    return out


def _narrow(wide: DataFrame, active: list[_Target]) -> None:
    """One sketch pass and one counting pass over all open brackets."""
    sketches = []
    for i, t in enumerate(active):
        first = max(0.0, (t.rank - t.below) / t.inside - t.slack)
        last = min(1.0, (t.next_rank + 1 - t.below) / t.inside + t.slack)
        sketches.append(F.percentile_approx(t.within(), [first, last], SKETCH_ACCURACY).alias(f"b{i}"))
    bounds = wide.agg(*sketches).first()
    checks = []
    for i, t in enumerate(active):
        c, (low, high) = F.col(t.slot), bounds[f"b{i}"]
        checks += [
            F.count_if(c < low).alias(f"below{i}"),
            F.count_if((c >= low) & (c <= high)).alias(f"inside{i}"),
            F.count_if((c > low) & (c < high)).alias(f"interior{i}"),
        ]
    seen = wide.agg(*checks).first()
    for i, t in enumerate(active):
        below, inside = seen[f"below{i}"], seen[f"inside{i}"]
        if below <= t.rank and t.next_rank < below + inside:
            t.low, t.high = bounds[f"b{i}"]
            t.below, t.inside, t.interior = below, inside, seen[f"interior{i}"]
        else:
            t.slack *= 4  # the sketch missed: keep the old bracket, look wider


def _ranked(wide: DataFrame, wanted: list[tuple[str, _Target, float]]):
    """Values at the wanted ranks, by discrete percentile inside each bracket."""
    exprs = []
    for name, t, p in wanted:
        inner = t.slot if t.low is None else (
            f"CASE WHEN {t.slot} BETWEEN CAST('{t.low!r}' AS DOUBLE) AND CAST('{t.high!r}' AS DOUBLE) THEN {t.slot} END"
        )
        exprs.append(F.expr(f"percentile_disc({p!r}D) WITHIN GROUP (ORDER BY {inner})").alias(name))
    return wide.agg(*exprs).first()


def grouped_median(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, median) with a crowded group spread over value ranges."""
    known = df.where(F.col(value).isNotNull())
    counts = known.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    totals = running_totals(counts, value, {"n": "upto"}, groups=keys)
    sizes = counts.groupBy(*keys).agg(F.sum("n").alias("size"))
    ranked = totals.join(sizes, keys)
    low, high = F.floor((F.col("size") - 1) / 2), F.floor(F.col("size") / 2)
    before = F.col("upto") - F.col("n")
    holds = lambda rank: (before <= rank) & (rank < F.col("upto"))
    middle = ranked.where(holds(low) | holds(high))
    return middle.groupBy(*keys).agg(((F.min(value) + F.max(value)) / 2).alias("median"))
