"""Pearson, Spearman and Kendall matrices over pairwise-complete rows.

Rank statistics work on the table of distinct value pairs with their counts,
so repeated values are combined before anything is shuffled, and ranks come
from running totals that never sort a whole column in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.columns import as_double, numeric_columns
from ..functions.running import running_totals
from ..functions.tables import batches, map_in_threads, one_row_to_long, union_all, union_or_gather
from ..session import stage

SQUARE = 6  # columns per block side: 36 products and 12 squares per aggregate
INCOMPLETE_PAIRS = 4


def _matrix(pairs: DataFrame, df: DataFrame, columns: Sequence[str], constant: set[str]) -> DataFrame:
    """Both triangles and the diagonal from (column_a, column_b, correlation)."""
    diagonal = df.sparkSession.createDataFrame(
        [(c, c, None if c in constant else 1.0) for c in columns], "column_a string, column_b string, correlation double"
    )
    flipped = pairs.select(F.col("column_b").alias("column_a"), F.col("column_a").alias("column_b"), "correlation")
    return union_all([pairs, flipped, diagonal])


def _facts(df: DataFrame, columns: Sequence[str]) -> dict:
    """Rows, and count, mean, minimum, maximum per column."""
    out, rows = {}, 0
    for names in batches(list(columns), 12):
        aggs = [F.count(F.lit(1)).alias("rows")]
        for i, c in enumerate(names):
            x = as_double(df, c)
            aggs += [F.count(x).alias(f"n{i}"), F.avg(x).alias(f"a{i}"), F.min(x).alias(f"l{i}"), F.max(x).alias(f"h{i}")]
        row = df.agg(*aggs).first()
        rows = row["rows"]
        out.update({c: (row[f"n{i}"], row[f"a{i}"], row[f"l{i}"], row[f"h{i}"]) for i, c in enumerate(names)})
    return {"rows": rows, "columns": out}


def _empty(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "column_a string, column_b string, correlation double")


def corr_matrix(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of every pair; null where a column is constant; empty below two columns."""
    names = list(columns if columns is not None else numeric_columns(df))
    if len(names) < 2:
        return _empty(df)
    facts = _facts(df, names)
    constant = _flat(facts)
    complete = [c for c in names if facts["columns"][c][0] == facts["rows"]]
    centred = df.select(
        *[(as_double(df, c) - F.lit(facts["columns"][c][1] or 0.0)).alias(f"x{i}") for i, c in enumerate(names)]
    )
    x = {c: F.col(f"x{i}") for i, c in enumerate(names)}
    whole, partial = [], []
    for pair in combinations(names, 2):
        (whole if pair[0] in complete and pair[1] in complete else partial).append(pair)
    parts = _complete_pairs(centred, x, complete, whole, constant) + _incomplete_pairs(centred, x, partial)
    return _matrix(union_or_gather(df, parts), df, names, constant)


def _clipped(c: Column) -> Column:
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(1.0)), F.lit(-1.0)))


def _complete_pairs(centred, x, columns, pairs, constant) -> list[DataFrame]:
    """Sums of products about the mean, in square blocks of columns."""
    parts = []
    sides = batches(columns, SQUARE)
    block_of = {c: k for k, side in enumerate(sides) for c in side}
    blocks: dict[tuple[int, int], list] = {}
    for a, b in pairs:
        blocks.setdefault((block_of[a], block_of[b]), []).append((a, b))
    for members in blocks.values():
        used = sorted({c for pair in members for c in pair}, key=columns.index)
        aggs = [F.sum(x[c] * x[c]).alias(f"s{columns.index(c)}") for c in used]
        entries = []
        for k, (a, b) in enumerate(members):
            aggs.append(F.sum(x[a] * x[b]).alias(f"p{k}"))
            scale = F.sqrt(f"s{columns.index(a)}") * F.sqrt(f"s{columns.index(b)}")
            value = F.lit(None).cast("double") if a in constant or b in constant else _clipped(F.try_divide(f"p{k}", scale))
            entries.append({"column_a": F.lit(a), "column_b": F.lit(b), "correlation": value})
        parts.append(one_row_to_long(centred.agg(*aggs), entries))
    return parts


def _incomplete_pairs(centred, x, pairs) -> list[DataFrame]:
    """The same over the rows where both values are present."""
    parts = []
    for members in batches(pairs, INCOMPLETE_PAIRS):
        aggs, entries = [], []
        for k, (a, b) in enumerate(members):
            u, v = F.when(x[b].isNotNull(), x[a]), F.when(x[a].isNotNull(), x[b])
            sums = {"n": F.count(u * v), "a": F.sum(u), "b": F.sum(v), "aa": F.sum(u * u), "bb": F.sum(v * v), "ab": F.sum(u * v),
                    "flat": (F.min(u) == F.max(u)) | (F.min(v) == F.max(v))}
            aggs += [s.alias(f"{name}{k}") for name, s in sums.items()]
            n, sa, sb = F.col(f"n{k}"), F.col(f"a{k}"), F.col(f"b{k}")
            cov = F.col(f"ab{k}") - F.try_divide(sa * sb, n)
            scale = F.sqrt(F.col(f"aa{k}") - F.try_divide(sa * sa, n)) * F.sqrt(F.col(f"bb{k}") - F.try_divide(sb * sb, n))
            value = F.when(~F.col(f"flat{k}"), _clipped(F.try_divide(cov, scale)))
            entries.append({"column_a": F.lit(a), "column_b": F.lit(b), "correlation": value})
        parts.append(one_row_to_long(centred.agg(*aggs), entries))
    return parts


def _joint(df: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) over the rows where both are present."""
    pair = df.select((as_double(df, a) + 0.0).alias("a"), (as_double(df, b) + 0.0).alias("b"))
    return pair.where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def _average_ranks(counts: DataFrame, value: str, rank: str) -> DataFrame:
    """(value, rank) from (value, m): ties share the mean of their places."""
    ranked = running_totals(counts, value, {"m": "upto"})
    return ranked.select(value, (F.col("upto") - F.col("m") + (F.col("m") + 1) / 2).alias(rank))


def corr_spearman(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Pearson correlation of average ranks.

    Against a column without missing values a column's ranks are those of the
    whole table, ranked once for all such pairs; other pairs rank their own rows.
    """
    names = list(columns if columns is not None else numeric_columns(df))
    if len(names) < 2:
        return _empty(df)
    facts = _facts(df, names)
    complete = {c for c in names if facts["columns"][c][0] == facts["rows"]}
    middle = F.lit((facts["rows"] + 1) / 2)

    def table_ranks(c: str) -> DataFrame:
        values = df.select((as_double(df, c) + 0.0).alias("v")).where("v is not null")
        return stage(_average_ranks(values.groupBy("v").agg(F.count(F.lit(1)).alias("m")), "v", "rank"), "ranks")

    ranked = [c for c in names if complete - {c}]
    whole = dict(zip(ranked, map_in_threads(df, table_ranks, ranked)))

    def ranks(joint: DataFrame, side: str, column: str, other: str) -> DataFrame:
        if other in complete:
            return whole[column].select(F.col("v").alias(side), F.col("rank").alias(f"rank_{side}"))
        return _average_ranks(joint.groupBy(side).agg(F.sum("n").alias("m")), side, f"rank_{side}")

    def one(a: str, b: str) -> DataFrame:
        joint = _joint(df, a, b)
        both = joint.join(ranks(joint, "a", a, b), "a").join(ranks(joint, "b", b, a), "b")
        # Any constant may be taken off both; near the mean rank it keeps the sums of squares from cancelling.
        w, u, v = F.col("n").cast("double"), F.col("rank_a") - middle, F.col("rank_b") - middle
        sums = both.agg(
            F.sum(w).alias("n"), F.sum(w * u).alias("su"), F.sum(w * v).alias("sv"),
            F.sum(w * u * u).alias("suu"), F.sum(w * v * v).alias("svv"), F.sum(w * u * v).alias("suv"),
        )
        cov = F.col("n") * F.col("suv") - F.col("su") * F.col("sv")
        scale = F.sqrt(F.col("n") * F.col("suu") - F.col("su") * F.col("su")) * F.sqrt(
            F.col("n") * F.col("svv") - F.col("sv") * F.col("sv")
        )
        return sums.select(_clipped(F.try_divide(cov, scale)).alias("correlation"))

    return _matrix(_pairs(df, names, one), df, names, _flat(facts))


def _pairs(df: DataFrame, columns: Sequence[str], one: Callable[[str, str], DataFrame]) -> DataFrame:
    """One query per pair and one number from each: a plan for all pairs at once would grow with their square."""
    pairs = list(combinations(columns, 2))
    values = map_in_threads(df, lambda pair: one(*pair).first()[0], pairs)
    rows = [(a, b, v) for (a, b), v in zip(pairs, values)]
    return df.sparkSession.createDataFrame(rows, "column_a string, column_b string, correlation double")


def _flat(facts: dict) -> set[str]:
    return {c for c, (_, _, low, high) in facts["columns"].items() if low == high}


def corr_kendall(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Kendall's tau-b without comparing pairs of rows."""
    names = list(columns if columns is not None else numeric_columns(df))
    if len(names) < 2:
        return _empty(df)
    pairs = _pairs(df, names, lambda a, b: _tau_b(stage(_joint(df, a, b), "joint")))
    return _matrix(pairs, df, names, _flat(_facts(df, names)))


def _pairs_within(counts: DataFrame, name: str) -> DataFrame:
    m = F.col("m").cast("double")
    return counts.agg(F.coalesce(F.sum(m * (m - 1) / 2), F.lit(0.0)).alias(name))


def _tau_b(joint: DataFrame) -> DataFrame:
    """Counts concordant pairs one binary digit of b's position at a time.

    Two positions first differ at exactly one digit, so each concordant pair is
    counted once: at that digit, under their common leading digits, as a row with
    digit 1 and the rows with digit 0 and a smaller a. That is a running total
    along a per (digit, leading digits), whose size does not depend on pairs.
    """
    by_b = joint.groupBy("b").agg(F.sum("n").alias("m"))
    distinct_b = by_b.count()
    digits = max(1, (max(distinct_b, 1) - 1).bit_length())
    positions = running_totals(by_b.select("b", F.lit(1).alias("one")), "b", {"one": "place"})
    placed = joint.join(positions.select("b", (F.col("place") - 1).cast("long").alias("place")), "b")
    split = placed.select("a", "n", "place", F.explode(F.sequence(F.lit(0), F.lit(digits - 1))).alias("digit")).select(
        "a", "n", "digit",
        F.expr("shiftright(place, digit + 1)").alias("lead"),
        (F.expr("shiftright(place, digit)") % 2).alias("bit"),
    )
    cells = split.groupBy("digit", "lead", "a").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("zeros"),
        F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("ones"),
    )
    totals = running_totals(cells, "a", {"zeros": "upto"}, groups=["digit", "lead"])
    concordant = totals.agg(
        F.coalesce(F.sum(F.col("ones").cast("double") * (F.col("upto") - F.col("zeros"))), F.lit(0.0)).alias("concordant")
    )
    by_a = joint.groupBy("a").agg(F.sum("n").alias("m"))
    n = F.col("rows").cast("double")
    parts = [
        concordant, _pairs_within(by_a, "ties_a"), _pairs_within(by_b, "ties_b"),
        _pairs_within(joint.withColumnRenamed("n", "m"), "ties_both"), joint.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows")),
    ]
    row = parts[0].withColumn("k", F.lit(1))
    for part in parts[1:]:
        row = row.join(part.withColumn("k", F.lit(1)), "k")
    pairs = n * (n - 1) / 2
    untied = pairs - F.col("ties_a") - F.col("ties_b") + F.col("ties_both")
    scale = F.sqrt(pairs - F.col("ties_a")) * F.sqrt(pairs - F.col("ties_b"))
    return row.select(_clipped(F.try_divide(2 * F.col("concordant") - untied, scale)).alias("correlation"))


def top_correlations(matrix: DataFrame, count: int = 5) -> DataFrame:
    """The highest positive and the lowest negative pairs, each pair once."""
    once = matrix.where(F.col("column_a") < F.col("column_b"))
    positive = once.where("correlation > 0").orderBy(F.desc("correlation"), "column_a", "column_b").limit(count)
    negative = once.where("correlation < 0").orderBy("correlation", "column_a", "column_b").limit(count)
    return positive.unionByName(negative)


def pivot_matrix(matrix: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Long matrix to one row and one column per variable."""
    return matrix.groupBy("column_a").pivot("column_b", list(columns)).agg(F.first("correlation")).withColumnRenamed(
        "column_a", "column"
    )
