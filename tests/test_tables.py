"""Profiling, cleaning, exploration and rules on edge tables."""

import datetime
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tablewright.functions import tables
from tablewright.operators import clean, correlation, eda, features, profile, tasks


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], "a double, b string, d timestamp")


@pytest.fixture(scope="module")
def edge(spark):
    rows = [
        (1, 2.0, None, "x", "2020-01-31", True, datetime.datetime(2020, 1, 1)),
        (2, float("nan"), None, "y", "2020-02-29", False, datetime.datetime(2020, 1, 2)),
        (3, 4.0, None, None, "bad", True, None),
        (3, 4.0, None, None, "bad", True, None),
    ]
    return spark.createDataFrame(rows, "i int, f double, n double, s string, t string, b boolean, d timestamp_ntz")


def as_dict(df, key="column"):
    return {r[key]: r.asDict() for r in df.collect()}


def test_profile_of_an_empty_table(empty):
    assert profile.profile_summary(empty).first().asDict() == {"rows": 0, "columns": 3, "duplicate_rows": 0, "total_missing": 0}
    rows = as_dict(profile.column_profile(empty))
    assert all(r["unique"] == 0 and not r["is_high_cardinality"] and r["is_low_cardinality"] for r in rows.values())


def test_nan_counts_as_missing_and_null_equals_null(edge):
    summary = profile.profile_summary(edge).first()
    assert (summary["rows"], summary["duplicate_rows"], summary["total_missing"]) == (4, 1, 1 + 4 + 2 + 2)
    facts = as_dict(profile.column_profile(edge))
    assert facts["f"]["missing"] == 1 and facts["f"]["unique"] == 2 and facts["f"]["is_binary"]
    assert facts["n"]["unique"] == 0
    assert facts["b"]["kind"] == "boolean" and facts["d"]["kind"] == "datetime"
    assert facts["i"]["is_high_cardinality"]  # 3 of 4
    assert not facts["f"]["is_high_cardinality"]  # exactly half


def test_estimated_distinct_values(edge):
    assert {r["column"]: r["unique"] for r in profile.unique_values(edge, ["i", "s"], exact=False).collect()} == {"i": 3, "s": 2}


@pytest.mark.parametrize("bad,is_date", [(10, True), (11, False)])
def test_date_share_threshold(spark, bad, is_date):
    rows = [(i, "2020-01-01" if i >= bad else "?") for i in range(50)] + [(99, "x")] * 5
    df = spark.createDataFrame(rows, "k int, t string")
    assert (profile.date_candidates(df, ["k"]).count() == 1) is is_date


@pytest.mark.parametrize("bad,is_number", [(4, True), (5, False)])
def test_number_share_threshold(spark, bad, is_number):
    df = spark.createDataFrame([(i, "$5" if i >= bad else "?") for i in range(50)], "k int, t string")
    assert (profile.numeric_like_text(df, ["k"]).count() == 1) is is_number


def test_day_first_dates_keep_their_layout(spark):
    df = spark.createDataFrame([(f"{d:02d}/03/2021",) for d in range(5, 29)], "t string")
    plan = clean.plan_cleaning(df)
    assert plan.dates == {"t": "dd/MM/yyyy"} and plan.numeric == []
    assert clean.clean_dataset(df, plan).where("t is null").count() == 0


def test_text_years_become_numbers(spark):
    df = spark.createDataFrame([(str(1990 + i),) for i in range(20)], "y string")
    plan = clean.plan_cleaning(df)
    assert plan.numeric == ["y"] and plan.dates == {}


def test_cleaning(edge):
    out = clean.clean_dataset(edge)
    rows = {r["i"]: r for r in out.collect()}
    assert len(rows) == 3 and rows[2]["f"] == 3.0  # median of 2 and 4
    assert rows[1]["n"] is None  # nothing to fill with
    assert rows[3]["s"] == "x" and rows[3]["d"] == datetime.datetime(2020, 1, 1)  # ties go to the smallest
    assert out.schema["i"].dataType.simpleString() == "int"
    report = clean.cleaning_report(edge).first()
    assert report["duplicates_removed"] == 1 and report["remaining_missing"] == 3 and report["rows_after_cleaning"] == 3


def test_integer_column_widens_only_for_a_fractional_median(spark):
    whole = clean.median_impute(spark.createDataFrame([(1,), (3,), (5,), (None,)], "x int"))
    half = clean.median_impute(spark.createDataFrame([(1,), (4,), (None,)], "x int"))
    assert whole.schema["x"].dataType.simpleString() == "int" and {r[0] for r in whole.collect()} == {1, 3, 5}
    assert half.schema["x"].dataType.simpleString() == "double" and {r[0] for r in half.collect()} == {1.0, 4.0, 2.5}


def test_unknown_only_without_a_mode(spark):
    df = spark.createDataFrame([("b", None), ("a", None), (None, None)], "x string, y string")
    assert {tuple(r) for r in clean.mode_or_unknown_impute(df).collect()} == {("b", "Unknown"), ("a", "Unknown")}


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.RandomState(1)
    pdf = pd.DataFrame({"a": rng.randint(0, 6, 400).astype(float), "b": rng.normal(size=400).round(1), "c": 3.0})
    pdf["e"] = pdf["a"] * 2 + rng.normal(size=400)
    pdf.loc[rng.rand(400) < 0.2, "a"] = np.nan
    pdf.loc[rng.rand(400) < 0.1, "b"] = np.nan
    return pdf, spark.createDataFrame(pdf).repartition(4)


def matrix(df):
    return {(r["column_a"], r["column_b"]): r["correlation"] for r in df.collect()}


def same_matrix(got, want):
    assert set(got) == {(a, b) for a in want for b in want}
    for (a, b), value in got.items():
        expected = want.loc[a, b]
        assert (value is None) if math.isnan(expected) else value == pytest.approx(expected, abs=1e-9), (a, b)


def test_pearson_over_complete_pairs(numbers):
    pdf, df = numbers
    same_matrix(matrix(correlation.corr_matrix(df)), pdf.corr())


def test_pearson_is_empty_below_two_columns(spark):
    assert correlation.corr_matrix(spark.createDataFrame([(1.0,)], "x double")).count() == 0


def test_spearman(numbers):
    pdf, df = numbers
    ranks = lambda a, b: pdf[[a, b]].dropna().rank().corr().iloc[0, 1] if a != b else pdf[a].corr(pdf[a])
    names = ["a", "b", "e"]
    want = pd.DataFrame([[ranks(a, b) for b in names] for a in names], names, names)
    same_matrix(matrix(correlation.corr_spearman(df, names)), want)


def tau_b(x, y):
    s = n1 = n2 = n0 = 0
    for i in range(len(x)):
        for j in range(i):
            p, q = np.sign(x[i] - x[j]), np.sign(y[i] - y[j])
            s, n0, n1, n2 = s + p * q, n0 + 1, n1 + (p == 0), n2 + (q == 0)
    return s / math.sqrt((n0 - n1) * (n0 - n2))


def test_kendall(numbers):
    pdf, df = numbers
    got = matrix(correlation.corr_kendall(df, ["a", "b"]))
    both = pdf[["a", "b"]].dropna().to_numpy()
    assert got["a", "b"] == pytest.approx(tau_b(both[:, 0], both[:, 1]), abs=1e-12)


def test_constant_column_has_no_rank_correlation(numbers):
    _, df = numbers
    assert matrix(correlation.corr_spearman(df, ["c", "e"]))["c", "e"] is None
    assert matrix(correlation.corr_kendall(df, ["c", "e"]))["c", "e"] is None


def test_summary_matches_pandas(numbers):
    pdf, df = numbers
    got = as_dict(eda.summary_statistics(df))
    want = pdf.describe()
    for c in pdf:
        for ours, theirs in {"mean": "mean", "std": "std", "min": "min", "p25": "25%", "p50": "50%", "p75": "75%", "max": "max"}.items():
            assert got[c][ours] == pytest.approx(want.loc[theirs, c], abs=1e-9)
        assert got[c]["unique"] == pdf[c].nunique()


def test_skewness_matches_pandas(numbers):
    pdf, df = numbers
    got = {r["column"]: r["skewness"] for r in eda.skewness(df).collect()}
    assert got == pytest.approx(pdf.skew().to_dict(), abs=1e-9)


def test_histogram_edges(numbers):
    pdf, df = numbers
    rows = eda.histogram(df, bins=10).collect()
    assert sum(r["count"] for r in rows if r["column"] == "a") == pdf["a"].count()
    assert [r["count"] for r in rows if r["column"] == "c" and r["bin"] == 0] == [400]
    counts, _ = np.histogram(pdf["e"], bins=10)
    assert [r["count"] for r in sorted((r for r in rows if r["column"] == "e"), key=lambda r: r["bin"])] == list(counts)


def test_density_integrates_to_one(numbers):
    _, df = numbers
    rows = sorted(eda.kde(df, "e", 400).collect(), key=lambda r: r["point"])
    area = np.trapezoid([r["density"] for r in rows], [r["x"] for r in rows])
    assert 0.95 < area <= 1.0


def profile_row(spark, **changes):
    base = dict(column="y", ordinal=0, type="double", kind="numerical", rows=100, missing=0, unique=30, is_binary=False,
                is_date_candidate=False, date_format=None, is_numeric_like=False, is_low_cardinality=False, is_high_cardinality=False)
    return {**base, **changes}


def profile_frame(spark, *rows):
    schema = (
        "column string, ordinal int, type string, kind string, rows long, missing long, unique long, is_binary boolean, is_date_candidate boolean, "
        "date_format string, is_numeric_like boolean, is_low_cardinality boolean, is_high_cardinality boolean"
    )
    return spark.createDataFrame([tuple(profile_row(spark, **r).values()) for r in rows], schema)


@pytest.mark.parametrize(
    "unique,task,confidence", [(5, "classification", "High"), (6, "classification", "Medium"), (20, "classification", "Medium"),
                               (21, "regression", "Medium"), (50, "regression", "Medium"), (51, "regression", "High")],
)
def test_numeric_target_thresholds(spark, unique, task, confidence):
    rows = tasks.detect_task(profile_frame(spark, {"unique": unique}, {"column": "x", "ordinal": 1, "kind": "categorical"}))
    meta = {r["target"]: r for r in tasks.task_metadata(rows).collect()}
    assert (meta["y"]["task"], meta["y"]["confidence"]) == (task, confidence)


def test_date_only_companions_mean_forecasting(spark):
    frame = profile_frame(spark, {"column": "d", "kind": "datetime"}, {"ordinal": 1})
    got = {r["target"]: r for r in tasks.detect_task(frame).collect()}
    assert got["y"]["task"] == "forecasting" and got["y"]["is_default"] and got["d"]["task"] == "unknown"


@pytest.mark.parametrize("dates,level", [(9, "Low"), (10, "Low"), (29, "Low"), (30, "Medium"), (99, "Medium"), (100, "High")])
def test_forecast_suitability_thresholds(spark, dates, level):
    frame = profile_frame(spark, {"column": "b", "kind": "datetime"}, {"column": "a", "kind": "datetime"}, {"ordinal": 2})
    uniques = spark.createDataFrame([("b", dates), ("a", dates)], "column string, unique_dates long")
    got = {r["target"]: r for r in tasks.forecast_suitability(frame, uniques).collect()}
    assert got["y"]["suitability"] == level and got["y"]["date_column"] == ("a" if dates >= 10 else None)
    assert got["a"]["suitability"] == "Low"


def test_sentences_name_three_columns(spark):
    frame = profile_frame(spark, *[{"column": c, "ordinal": i, "is_binary": True} for i, c in enumerate("wxyz")])
    report = spark.createDataFrame([(0, [], ["d"], 0)], "duplicates_removed long, numeric_converted array<string>, date_converted array<string>, remaining_missing long")
    got = [r["insight"] for r in tasks.insights_eda(frame, report).collect()]
    assert got[1] == "Binary/Boolean features identified: w, x, y..." + "." and len(got) == 3


@pytest.mark.parametrize("size", [0.2, 0.5])
def test_stratified_split_takes_the_ceiling_of_every_class(spark, size):
    rows = [(i, "a" if i % 3 else "b") for i in range(400)] + [(1000 + i, "rare") for i in range(3)]
    out = features.stratified_split(spark.createDataFrame(rows, "k int, y string").repartition(5), ["k"], "y", size)
    assert out.count() == len(rows)
    got = {(r["y"], r["split"]): r["count"] for r in out.groupBy("y", "split").count().collect()}
    for y in ("a", "b", "rare"):
        n = sum(1 for r in rows if r[1] == y)
        assert got[y, "test"] == math.ceil(size * n)


def test_stratified_split_falls_back_for_a_single_row_class(spark):
    rows = [(i, "a") for i in range(200)] + [(999, "b")]
    out = features.stratified_split(spark.createDataFrame(rows, "k int, y string"), ["k"], "y")
    assert 15 < out.where("split = 'test'").count() < 70


def test_category_limit(spark):
    rows = [(i, f"c{i % 60:02d}") for i in range(600)] + [(1000 + i, "c59") for i in range(50)]
    df = spark.createDataFrame(rows, "k int, c string")
    kept, pool = features.fit_categories(df, ["c"])["c"]
    assert pool and len(kept) == 49 and "c59" in kept
    out = features.one_hot_encode(df, ["k"], ["c"])
    assert out.select("category").distinct().count() == 50 and out.count() == len(rows)
    exact = features.fit_categories(df.where("k < 50"), ["c"])["c"]
    assert len(exact[0]) == 50 and not exact[1]


def test_frequencies_of_text_and_dates(edge):
    got = as_dict(eda.top_freq(edge))
    assert got["t"]["top"] == "bad" and got["t"]["freq"] == 2 and got["b"]["top"] == "true"
    assert F is not None


def test_odd_column_names(spark):
    df = spark.createDataFrame([(float(i), "x") for i in range(9)] + [(500.0, None)], ["a.b c", "R² %"])
    assert {r["column"] for r in eda.histogram(df, bins=3).collect()} == {"a.b c"}
    assert [(r["column"], r["value"]) for r in eda.boxplot_outliers(df).collect()] == [("a.b c", 500.0)]
    assert {r["column"] for r in profile.column_profile(df).collect()} == {"a.b c", "R² %"}
    assert clean.clean_dataset(df).where("`R² %` is null").count() == 0


def test_a_wide_table_runs_in_parts(spark, monkeypatch):
    monkeypatch.setattr(tables, "BRANCHES", 2)
    names = [f"c{i}" for i in range(14)]
    df = spark.createDataFrame([tuple(float(min(i, j)) for j in range(14)) for i in range(14)], names).coalesce(2)
    got = {r["column"]: r["unique"] for r in profile.unique_values(df.select(names[:5])).collect()}
    assert got == {f"c{j}": j + 1 for j in range(5)}
    assert profile.high_cardinality(df.select(names[5:9])).count() == 2
    pairs = matrix(correlation.corr_matrix(df))
    assert len(pairs) == 196 and pairs["c0", "c5"] is None and pairs["c12", "c13"] > 0.99


def test_stratified_split_of_equal_rows(spark):
    from tablewright.operators import features

    df = spark.createDataFrame([("a", 1)] * 50 + [("b", 2)] * 50 + [("c", 3)] * 7, "y string, v int")
    out = features.stratified_split(df, ["y", "v"], "y").groupBy("y", "split").count().collect()
    assert {(r.y, r.split): r["count"] for r in out} == {
        ("a", "test"): 10, ("a", "train"): 40, ("b", "test"): 10, ("b", "train"): 40, ("c", "test"): 2, ("c", "train"): 5
    }


@pytest.mark.parametrize("aggregate, want", [
    ("sum", [3.0, 0.0, 0.0, 5.0]), ("count", [2.0, 0.0, 0.0, 1.0]), ("size", [2.0, 0.0, 0.0, 1.0]), ("prod", [2.0, 1.0, 1.0, 5.0]),
    ("first", [2.0, 5.0]), ("last", [1.0, 5.0]), ("mean", [1.5, 5.0]),
])
def test_resample_of_a_gap(spark, aggregate, want):
    from tablewright.operators import timeseries

    rows = [("2024-01-01 05:00:00", 1.0), ("2024-01-01 01:00:00", 2.0), ("2024-01-04 00:00:00", 5.0), ("2024-01-03 00:00:00", None)]
    df = spark.createDataFrame(rows, "d string, v double")
    assert [r.y for r in timeseries.resample(df, "d", "v", "D", aggregate).orderBy("ds").collect()] == want


def test_registered_split_has_ties_at_the_border(spark):
    from tablewright import catalog

    rows = catalog.QUERIES["stratified_split_duplicates"](spark, "/root/testdata/sf0.001").collect()
    orders = spark.read.parquet("/root/testdata/sf0.001/orders.parquet")
    for status, n in orders.groupBy("o_orderstatus").count().collect():
        own = [r for r in rows if r.o_orderstatus == status]
        assert sum(r.n for r in own) == n and sum(r.test for r in own) == math.ceil(0.2 * n)
        assert sum(0 < r.test < r.n for r in own) <= 1
    assert any(0 < r.test < r.n for r in rows)
