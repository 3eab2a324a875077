"""Time series and forecasts on hand-made series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.operators import forecast as G, timeseries as S
from tablewright.plans.forecasting import forecast_engine_fallback


def frame(spark, days, values=None, name="s"):
    start = dt.datetime(2020, 1, 6)  # a Monday
    return spark.createDataFrame(
        [(name, start + dt.timedelta(days=d), float(v)) for d, v in zip(days, values if values is not None else days)],
        "series string, ds timestamp_ntz, y double",
    )


@pytest.mark.parametrize(
    "days,code",
    [(range(20), "D"), (range(0, 140, 7), "W"), ([0, 1, 4, 6, 9, 15, 16], "D"), ([0, 6, 11, 17, 22], "W"), ([0, 40, 70, 99], "MS"),
     ([0], "D"), ([0, 0, 0, 0, 0, 30, 61], "D")],
)
def test_frequency(spark, days, code):
    days = list(days)
    assert S.detect_frequency(frame(spark, days), "ds").first()["frequency"] == code


def test_month_starts_and_ends(spark):
    for rows in ([dt.datetime(2020, m, 1) for m in range(1, 9)], [dt.datetime(2020, m + 1, 1) - dt.timedelta(days=1) for m in range(1, 9)]):
        df = spark.createDataFrame([(r, 1.0) for r in rows], "ds timestamp_ntz, y double")
        assert S.detect_frequency(df, "ds").first()["frequency"] == "MS"


def test_week_label_is_its_sunday(spark):
    rows = S.resample_weekly(frame(spark, [0, 6, 7], [1, 3, 5]), "ds", "y").orderBy("ds").collect()
    assert [(r["ds"].date(), r["y"]) for r in rows] == [(dt.date(2020, 1, 12), 2.0), (dt.date(2020, 1, 19), 5.0)]


def test_text_dates_and_gaps(spark):
    df = spark.createDataFrame([("2020-01-01", "1"), ("2020-01-03", "3"), ("never", "9"), ("2020-01-04", None)], "d string, v string")
    ts = S.prepare_time_series(df.withColumn("v", F.col("v").cast("double")), "d", "v", "D")
    assert [r["y"] for r in ts.collect()] == [1.0, 3.0]
    grid = S.regular_grid_ffill(ts, "D").orderBy("ds").collect()
    assert [r["y"] for r in grid] == [1.0, 1.0, 3.0]


def test_future_months(spark):
    ts = spark.createDataFrame([(dt.datetime(2020, 11, 1), 1.0)], "ds timestamp_ntz, y double")
    assert [r["ds"].month for r in S.future_dates(ts, "MS", 3).orderBy("step").collect()] == [12, 1, 2]


def recursion(y, period, al, be, ga):
    """Plain additive recursion, as a second opinion."""
    m1, m2 = np.mean(y[:period]), np.mean(y[period : 2 * period])
    b = (m2 - m1) / period
    l, s, fitted = m1 - b, [v - m1 for v in y[:period]], []
    for v in y:
        fitted.append(l + b + s[0])
        new = al * (v - s[0]) + (1 - al) * (l + b)
        s = s[1:] + [ga * (v - new) + (1 - ga) * s[0]]
        b, l = be * (new - l) + (1 - be) * b, new
    return fitted, l, b, s


def test_smoothing_matches_the_recursion(spark):
    rng = np.random.RandomState(1)
    y = [10 + 0.2 * i + 3 * (i % 7 == 5) + rng.normal() * 0.3 for i in range(60)]
    out = G.holt_winters(frame(spark, range(60), y), "D", 9, ["series"]).orderBy("ds").collect()
    best = min(
        (sum((a - f) ** 2 for a, f in zip(y, recursion(y, 7, *w)[0])), w)
        for w in [(a, b, g) for a in G.SMOOTHING for b in G.TREND_SMOOTHING for g in G.SEASON_SMOOTHING]
    )[1]
    fitted, l, b, s = recursion(y, 7, *best)
    future = [l + h * b + s[(h - 1) % 7] for h in range(1, 10)]
    assert [r["forecast"] for r in out] == pytest.approx(fitted + future, abs=1e-9)
    half = 1.96 * np.std(np.array(y) - fitted, ddof=1)
    assert out[0]["upper_bound"] - out[0]["forecast"] == pytest.approx(half)


def test_short_series_have_a_trend_only(spark):
    out = G.holt_winters(frame(spark, range(13), range(13)), "D", 3).orderBy("ds").collect()
    assert [r["forecast"] for r in out[-3:]] == pytest.approx([13, 14, 15])


def test_trend_and_week_are_recovered(spark):
    y = [5 + 0.5 * i + 2 * np.sin(2 * np.pi * i / 7) for i in range(120)]
    out = G.trend_seasonal_forecast(frame(spark, range(120), y), "D", 14, ["series"]).orderBy("ds").collect()
    want = [5 + 0.5 * i + 2 * np.sin(2 * np.pi * i / 7) for i in range(134)]
    assert len(out) == 134 and [r["kind"] for r in out[-14:]] == ["forecast"] * 14
    assert max(abs(r["forecast"] - w) for r, w in zip(out, want)) < 0.5


def test_fallback_and_failure(spark):
    good, single = frame(spark, range(30), range(30), "good"), frame(spark, [3], [1], "single")
    out = forecast_engine_fallback(good.unionByName(single), "D", 7, ["series"])
    got = {r["series"]: r for r in out.groupBy("series").agg(F.max("engine").alias("engine"), F.max("error").alias("error"), F.count("ds").alias("n")).collect()}
    assert got["good"]["engine"] == "Trend and seasons" and got["good"]["n"] == 37
    assert got["single"]["engine"] is None and "Holt-Winters" in got["single"]["error"] and got["single"]["n"] == 0


@pytest.mark.parametrize("second,strength", [(101.9, "None"), (102.1, "Weak"), (104.9, "Weak"), (105.1, "Moderate"), (114.9, "Moderate"), (115.1, "Strong"), (80.0, "Strong")])
def test_trend_thresholds(spark, second, strength):
    rows = [(dt.datetime(2020, 1, d + 1), 100.0 if d < 2 else second) for d in range(5)]  # five rows: two against three
    row = G.trend_direction(spark.createDataFrame(rows, "ds timestamp_ntz, forecast double")).first()
    assert row["trend_strength"] == strength
    if strength != "None":
        assert ("Upward" if second > 100 else "Downward") in row["trend_direction"]


def test_number_text(spark):
    df = spark.createDataFrame([(1.0,), (0.12345,), (10.5,), (100.0,)], "x double")
    assert [r[0] for r in df.select(G.plain_number(F.col("x"))).collect()] == ["1.0", "0.1235", "10.5", "100.0"]


@pytest.mark.parametrize("seed", range(6))
def test_sparse_fit_meets_the_optimality_conditions(seed):
    random = np.random.RandomState(seed)
    t = np.linspace(0, 1, 400)
    knots = np.linspace(0, 0.8, 26)[1:]
    waves = [f(2 * np.pi * k * t * 57) for k in (1, 2, 3) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones_like(t), t, *[np.clip(t - k, 0, None) for k in knots], *waves])
    y = 0.4 + 0.3 * t + 0.9 * np.clip(t - knots[8], 0, None) - 1.1 * np.clip(t - knots[15], 0, None) + 0.05 * random.normal(size=len(t))
    ridge = np.array([1e-8] * 2 + [0.0] * 25 + [1e-4] * 6)
    sparse = np.array([0.0] * 2 + [0.05] * 25 + [0.0] * 6)
    w = G.sparse_fit(x, y, ridge, sparse)
    slope = x.T @ (y - x @ w) - ridge * w
    change = sparse > 0
    assert np.abs(slope[~change]).max() < 1e-6
    assert np.abs(slope - sparse * np.sign(w))[change & (w != 0)].max(initial=0.0) < 1e-6
    assert (np.abs(slope)[change & (w == 0)] <= 0.05 + 1e-6).all()
    assert 1 <= np.count_nonzero(w[change]) <= 12


def test_intervals_widen_with_the_horizon(spark):
    random = np.random.RandomState(3)
    y = np.cumsum(np.where(np.arange(200) < 90, 1.0, -0.7)) + random.normal(size=200)
    out = G.trend_seasonal_forecast(frame(spark, range(200), y), "D", 60, ["series"]).orderBy("ds").collect()
    width = [r["upper_bound"] - r["lower_bound"] for r in out]
    assert len(set(np.round(width[:200], 9))) == 1
    assert all(b > a for a, b in zip(width[199:], width[200:])) and width[-1] > 1.2 * width[0]
    assert abs(out[-1]["forecast"] - (y[-1] - 0.7 * 60)) < 12


@pytest.mark.parametrize("period", [0, 4])
def test_smoothing_weights_are_searched(period):
    random = np.random.RandomState(6)
    t = np.arange(60)
    y = np.stack([10 + a * t + b * np.sin(np.pi * t / 2) + np.cumsum(random.normal(size=60)) * c for a, b, c in ((0.1, 3, 0.2), (-0.4, 1, 1.0), (0, 0, 2.0))])
    coarse = [(a, b, g) for a in G.SMOOTHING for b in G.TREND_SMOOTHING for g in (G.SEASON_SMOOTHING if period else [0.0])]
    fine = np.linspace(0, 1, 21)
    dense = [(a, b, g) for a in fine for b in fine for g in (fine if period else [0.0])]
    squares = lambda grid, search: G.smooth(y, period, grid, search)[1][4]
    found = squares(coarse, True)
    assert (found <= squares(coarse, False) + 1e-9).all() and (found <= squares(dense, False) * 1.01).all()
    weights, (level, trend, season, total, sse, ahead) = G.smooth(y, period, coarse, True)
    assert np.allclose(((y - ahead) ** 2).sum(1), sse) and ((weights >= 0) & (weights <= 1)).all()


@pytest.mark.parametrize("periods, weights", [(14, 12), (60, 47)])
def test_fits_side_by_side_are_those_of_one(periods, weights):
    rng = np.random.RandomState(periods)
    x = rng.normal(size=(40, periods, weights))
    y = x[:, :, :4].sum(2) + rng.normal(size=(40, periods))
    ridge, sparse = np.where(np.arange(weights) < 2, 1e-8, 1e-6), np.where(np.arange(weights) < 2, 0.0, rng.uniform(0.05, 5, weights))
    together = G.sparse_fits(x, y, ridge, sparse)
    assert together == pytest.approx(np.stack([G.sparse_fit(a, b, ridge, sparse) for a, b in zip(x, y)]), abs=1e-6)


def test_trend_forecast_solves_series_in_batches(spark, monkeypatch):
    """Not one call of Python a series, whatever it is."""
    df = spark.range(300).selectExpr("id as series", "explode(sequence(0, 9)) as k").selectExpr(
        "series", "cast(timestamp'2020-01-01' + make_interval(0, k) as timestamp_ntz) as ds", "cast(series + k * k as double) as y"
    ).where("series > 0 or k = 0")
    out = G.trend_seasonal_forecast(df, "MS", 2, ["series"])
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().toString()
    rows = out.groupBy("series").agg(F.count("ds").alias("n"), F.max("error").alias("error")).collect()
    assert {r["series"]: (r["n"], r["error"]) for r in rows} == {i: (12, None) if i else (0, "fewer than two observations") for i in range(300)}


def test_empty_periods_need_no_join(spark):
    day = lambda m, d: dt.datetime(2020, m, d)
    rows = [("a", day(1, 5), 2.0), ("a", day(1, 9), 3.0), ("a", day(4, 1), 5.0), (None, day(2, 1), 1.0), (None, day(4, 30), 1.0), ("b", day(3, 3), 7.0)]
    out = S.resample(spark.createDataFrame(rows, "series string, ds timestamp_ntz, y double"), "ds", "y", "MS", "sum", ["series"])
    got = sorted((r["series"] or "", r["ds"].month, r["y"]) for r in out.collect())
    assert got == [("", 2, 1.0), ("", 3, 0.0), ("", 4, 1.0), ("a", 1, 5.0), ("a", 2, 0.0), ("a", 3, 0.0), ("a", 4, 5.0), ("b", 3, 7.0)]
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
