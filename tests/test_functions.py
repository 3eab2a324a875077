"""Shared functions against plain Python on data small enough to check by hand."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.functions import copies, quantiles, running
from tablewright.functions.columns import NA_TOKENS, parse_date, parse_number, sanitize_names, sanitized_name


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows hold one value; the rest spread unevenly, with nulls."""
    rng = random.Random(3)
    values = [5.0] * 4000 + [round(rng.expovariate(0.01), 2) for _ in range(7000)] + [None] * 500 + [float(i % 7) for i in range(1000)]
    rng.shuffle(values)
    return values, spark.createDataFrame([(v,) for v in values], "x double").repartition(6)


@pytest.mark.parametrize("limit", [10, 300, 100_000])
def test_quantiles_are_exact_at_any_narrowing(skewed, limit):
    values, df = skewed
    known = np.array([v for v in values if v is not None])
    probabilities = [0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]
    found = quantiles.exact_quantiles(df, {"x": F.col("x")}, probabilities, values_per_task=limit)["x"]
    assert found == pytest.approx(list(np.quantile(known, probabilities)), rel=1e-12)


def test_quantiles_of_nothing_and_of_one_value(spark):
    df = spark.createDataFrame([(None, 2.0), (None, 2.0)], "a double, b double")
    found = quantiles.exact_quantiles(df, {"a": F.col("a"), "b": F.col("b")}, [0.5], values_per_task=1)
    assert found == {"a": [None], "b": [2.0]}


@pytest.fixture(params=["true", "false"])
def ranges(request, spark):
    """One range, as these tables are small, or as many as there are partitions."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", request.param)
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals_match_a_full_sort(skewed, ranges, descending):
    values, df = skewed
    counts = df.where("x is not null").groupBy("x").agg(F.count(F.lit(1)).alias("n"))
    got = {r["x"]: r["upto"] for r in running.running_totals(counts, "x", {"n": "upto"}, descending=descending).collect()}
    known = sorted((v for v in values if v is not None), reverse=descending)
    want = {v: i + 1 for i, v in enumerate(known)}
    assert got == want


def test_running_totals_per_group(spark, ranges):
    rows = [("a", float(i), 1) for i in range(40)] + [("b", float(i), 2) for i in range(0, 40, 3)]
    df = spark.createDataFrame(rows, "g string, x double, n int")
    got = {(r["g"], r["x"]): r["s"] for r in running.running_totals(df, "x", {"n": "s"}, groups=["g"]).collect()}
    want, sums = {}, {"a": 0, "b": 0}
    for g, x, n in sorted(rows, key=lambda r: r[1]):
        sums[g] += n
        want[g, x] = sums[g]
    assert got == want


def test_positions_of_texts_and_numbers(spark, ranges):
    words = [f"w{i:03d}" for i in range(60)]
    df = spark.createDataFrame([(w, float(i) / 3) for i, w in enumerate(words)], "w string, v double").repartition(5)
    by_text = {r["w"]: r["p"] for r in running.positions(df.select("w"), "w", "p").collect()}
    assert by_text == {w: i for i, w in enumerate(words)}
    by_number = {r["v"]: r["p"] for r in running.positions(df.select("v"), "v", "p").collect()}
    assert by_number == {float(i) / 3: i for i in range(60)}


def test_grouped_median(spark, ranges):
    rng = random.Random(5)
    rows = [(g, float(rng.randint(0, 9))) for g in "ab" for _ in range(31 if g == "a" else 200)] + [("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r["median"] for r in quantiles.grouped_median(df, ["g"], "v").collect()}
    assert got == {g: float(np.median([v for k, v in rows if k == g])) for g in "ab"}


def test_numbers_in_text(spark):
    cases = {"$1,234.50": 1234.5, "+7%": 7.0, "-3": -3.0, "1e3": 1000.0, "12d": None, "": None, "abc": None, "1.2.3": None, " 5 ": 5.0, ".5": 0.5}
    df = spark.createDataFrame([(c,) for c in cases], "t string")
    assert {r["t"]: r["v"] for r in df.select("t", parse_number(F.col("t")).alias("v")).collect()} == cases


def test_dates_in_text(spark):
    df = spark.createDataFrame([("31/12/2020",), ("2020-13-01",), ("01/02/2020",)], "t string")
    got = [r["d"] for r in df.select(parse_date(F.col("t"), ["MM/dd/yyyy", "dd/MM/yyyy"]).alias("d")).collect()]
    assert [d and (d.month, d.day) for d in got] == [(12, 31), None, (1, 2)]


def test_names_for_the_warehouse(spark):
    raw = ["R² (test)", "Growth %", "a  b", "a b", "__x__", "é", "A-B"]
    assert sanitize_names(raw) == ["r2_test", "growth_pct", "a_b", "a_b_2", "x", "", "ab"]
    df = spark.createDataFrame([(n,) for n in raw], "n string")
    assert [r[0] for r in df.select(sanitized_name(F.col("n"))).collect()] == ["r2_test", "growth_pct", "a_b", "a_b", "x", "", "ab"]


def test_token_list_has_no_repeats():
    assert len(NA_TOKENS) == len(set(NA_TOKENS)) == 19


def test_repeated_rows(spark):
    rows = [(i % 40, None if i % 5 == 0 else f"t{i % 8}", float("nan") if i % 3 else 1.0) for i in range(300)]
    rows += [(1000 + i, "only", 0.0) for i in range(30)]
    df = spark.createDataFrame(rows, "a int, b string, x double").repartition(4)
    want = {(a, b, None if x != x else x) for a, b, x in rows}
    out = copies.distinct_rows(df).collect()
    assert len(out) == len(want) and {tuple(r) for r in out} == want
    assert copies.surplus_rows(df).first()[0] == len(rows) - len(want)


@pytest.mark.parametrize("text, want", [
    ("2024-01-02 10:30", "2024-01-02 10:30:00"), ("2024-01-02T10:30:00Z", "2024-01-02 10:30:00"), ("2024-01-02T10:30:00+02:00", "2024-01-02 08:30:00"),
    ("2024-01-02 10:30:00.123", "2024-01-02 10:30:00.123000"), ("01/02/2024 10:30", "2024-01-02 10:30:00"), ("2-Jan-2024", "2024-01-02 00:00:00"),
    ("01/02/24", "2024-01-02 00:00:00"), ("31/12/24", "2024-12-31 00:00:00"), ("01/02/2024", "2024-01-02 00:00:00"), ("x", None),
])
def test_date_layouts(spark, text, want):
    from tablewright.functions.columns import DATE_FORMATS, parse_date

    got = spark.createDataFrame([(text,)], "t string").select(parse_date(F.col("t"), DATE_FORMATS)).first()[0]
    assert (got and str(got)) == want
