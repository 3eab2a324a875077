"""Forecasting of many series at once, and the tables derived from a forecast.

A series is an array of its periods, so its size is bounded by the calendar.
Smoothing and the trend and season model run over the series of an Arrow
batch side by side; the latter is one small convex problem per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.tables import join_by, spread_by, union_all
from .timeseries import DAILY, MONTHLY, WEEKLY, per_period, regular_grid_ffill

PERIODS = {DAILY: 7, WEEKLY: 52, MONTHLY: 12}
SMOOTHING = [0.1, 0.3, 0.5, 0.7, 0.9]
TREND_SMOOTHING = [0.01, 0.1, 0.3]
SEASON_SMOOTHING = [0.05, 0.2, 0.4]
BAND = 1.96


STEPS = 14  # halvings of the step of the weight search
TURNS = 3  # of the search for weights and for starting states
SERIES_AT_ONCE = 512


def _errors(y, al, be, ga, level, trend, season, keep=False):
    """One pass of exponential smoothing over the rows of ``y`` (series by periods), all at once.

    Weights and starting states have one entry a row; ``season`` has a column for each phase, or none. Returns the final
    states and the sums of errors and squares one step ahead; with ``keep`` also what was expected at every period.
    """
    import numpy as np

    season, period = season.copy(), season.shape[1]
    total, squares = np.zeros(len(y)), np.zeros(len(y))
    ahead = np.empty_like(y) if keep else None
    for t in range(y.shape[1]):
        s = season[:, t % period] if period else 0.0
        expected = level + trend + s
        error = y[:, t] - expected
        new = al * (y[:, t] - s) + (1 - al) * (level + trend)
        trend = be * (new - level) + (1 - be) * trend
        level = new
        if period:
            season[:, t % period] = ga * (y[:, t] - level) + (1 - ga) * s
        total += error
        squares += error * error
        if keep:
            ahead[:, t] = expected
    return level, trend, season, total, squares, ahead


def _starts(y, period):
    """Level and trend from the first two seasons, the season from the first one; without a season from two periods."""
    import numpy as np

    if not period:
        return 2 * y[:, 0] - y[:, 1], y[:, 1] - y[:, 0], np.zeros((len(y), 0))
    first = y[:, :period].mean(1)
    trend = (y[:, period : 2 * period].mean(1) - first) / period
    return first - trend, trend, y[:, :period] - first[:, None]


def _of_grid(y, start, grid):
    """The weights of ``grid`` with the least squares of each row, the first of equal ones, and the squares."""
    import numpy as np

    squares = np.stack([_errors(y, *[np.full(len(y), w) for w in g], *start)[4] for g in grid], 1)
    best = squares.argmin(1)
    return np.array(grid)[best].T, squares[np.arange(len(y)), best]


def _searched(y, start, weights, squares):
    """Weights moved along each axis by steps that are halved when none of them is better."""
    import numpy as np

    step = np.full(len(y), 0.1)
    for _ in range(6 * STEPS):
        tried, best, found = weights, squares, np.zeros(len(y), bool)
        for axis in range(3 if start[2].shape[1] else 2):
            for side in (-1, 1):
                moved = weights.copy()
                moved[axis] = np.clip(moved[axis] + side * step, 0.0, 1.0)
                now = _errors(y, *moved, *start)[4]
                better = now < best
                tried, best, found = np.where(better, moved, tried), np.where(better, now, best), found | better
        weights, squares = tried, best
        step = np.where(found, step, step / 2)
        if (step < 0.1 / 2**STEPS).all():
            break
    return weights, squares


def _best_starts(y, start, weights):
    """Starting states with the least squares: errors are linear in them, so that this is one linear system a row."""
    import numpy as np

    rows, period = len(y), start[2].shape[1]
    base = y - _errors(y, *weights, *start, keep=True)[5]
    response = []
    for k in range(2 + period):
        level, trend, season = np.zeros(rows), np.zeros(rows), np.zeros((rows, period))
        (level if k == 0 else trend if k == 1 else season[:, k - 2])[:] = 1.0
        response.append(_errors(np.zeros_like(y), *weights, level, trend, season, keep=True)[5])
    x = np.stack(response, 2)
    gram = np.einsum("rtk,rtl->rkl", x, x)
    gram += np.eye(2 + period) * (1e-9 * np.trace(gram, axis1=1, axis2=2)[:, None, None] + 1e-12)  # level and season shift together
    change = np.linalg.solve(gram, np.einsum("rtk,rt->rk", x, base)[:, :, None])[:, :, 0]
    return start[0] + change[:, 0], start[1] + change[:, 1], start[2] + change[:, 2:]


def smooth(y, period: int, grid, search: bool):
    """Weights, starting and final states of each row of ``y``. ``search`` goes on from the best weights of the grid."""
    import numpy as np

    start = _starts(y, period)
    weights, squares = _of_grid(y, start, grid)
    for _ in range(TURNS if search else 0):
        weights, squares = _searched(y, start, weights, squares)
        other = _best_starts(y, start, weights)
        now = _errors(y, *weights, *other)[4]
        better = now < squares
        start = tuple(np.where(better if old.ndim == 1 else better[:, None], new, old) for old, new in zip(start, other))
        squares = np.where(better, now, squares)
    return weights, _errors(y, *weights, *start, keep=True)


def _smoother(season: bool, period: int, weights, search: bool):
    """Column function: values of a series -> weights, final states, errors and fitted values."""
    al, be, ga = weights or (SMOOTHING, TREND_SMOOTHING, SEASON_SMOOTHING)
    grid = [(float(a), float(b), float(g)) for a in al for b in be for g in (ga if season else [0.0])]

    @F.pandas_udf("struct<al double, be double, ga double, l double, b double, s array<double>, n long, sum double, sse double, fitted array<double>>")
    def smoothed(values):
        import numpy as np
        import pandas as pd

        out = [None] * len(values)
        lengths = values.map(len).to_numpy()
        for length in np.unique(lengths):  # series of one length side by side
            every = np.flatnonzero(lengths == length)
            for own in (every[i : i + SERIES_AT_ONCE] for i in range(0, len(every), SERIES_AT_ONCE)):
                y = np.stack(values.iloc[own].to_numpy()).astype(float)
                w, (level, trend, phases, total, squares, ahead) = smooth(y, period if season else 0, grid, search)
                turn = length % period if season else 0
                phases = np.roll(phases, -turn, axis=1)  # the coming phase first
                for k, i in enumerate(own):
                    out[i] = (*w[:, k], level[k], trend[k], phases[k], length, total[k], squares[k], ahead[k])
        return pd.DataFrame(out, columns=["al", "be", "ga", "l", "b", "s", "n", "sum", "sse", "fitted"])

    return smoothed


def _arrays(ts: DataFrame, series: Sequence[str]) -> DataFrame:
    """One row per series with its values and periods in time order."""
    pairs = F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    rows = spread_by(ts.groupBy(*series).agg(pairs.alias("pairs")), series, whole_groups=True)
    return rows.select(
        *series, F.transform("pairs", lambda p: p["y"]).alias("ys"), F.transform("pairs", lambda p: p["ds"]).alias("dates")
    ).where("size(ys) >= 2")


def holt_winters(ts: DataFrame, freq: str, horizon: int, series: Sequence[str] = (), weights=None, search: bool = False) -> DataFrame:
    """Fitted history and ``horizon`` future periods per series, with a residual band.

    Additive trend and, with two full seasons of data, additive season. Of a grid of weights (``weights``: lists for level,
    trend and season) that of the least squared error one step ahead is taken; with ``search`` the weights are moved on from
    there, and the starting states solved with them.
    Rows of one period are averaged first, so a series, which is one row from the
    collected periods to the exploded forecast, is bounded by the calendar.
    """
    period = PERIODS[freq]
    arrays = _arrays(regular_grid_ffill(per_period(ts, freq, series), freq, series), series)
    step = {DAILY: "make_interval(0, 0, 0, k)", WEEKLY: "make_interval(0, 0, k)", MONTHLY: "make_interval(0, k)"}[freq]
    parts = []
    for season in (True, False):
        enough = F.size("ys") >= 2 * period
        rows = arrays.where(enough if season else ~enough).withColumn("st", _smoother(season, period, weights, search)("ys"))
        seasonal = f"st.s[cast((k - 1) % {period} as int)]" if season else "0D"
        future = F.expr(
            f"transform(sequence(1, {horizon}), k -> named_struct('ds', cast(dates[size(dates) - 1] + {step} as timestamp_ntz), "
            f"'kind', 'forecast', 'forecast', st.l + k * st.b + {seasonal}))"
        )
        past = F.expr("transform(dates, (d, i) -> named_struct('ds', d, 'kind', 'fitted', 'forecast', st.fitted[i]))")
        spread = F.sqrt(F.try_divide(F.col("st.sse") - F.col("st.sum") * F.col("st.sum") / F.col("st.n"), F.col("st.n") - 1))
        # The outer form keeps the optimizer from testing the array for rows first, which would smooth twice.
        parts.append(rows.select(*series, (F.lit(BAND) * spread).alias("half"), F.inline_outer(F.concat(past, future))))
    return union_all(parts).select(
        *series, *[F.col(c) for c in ("ds", "kind", "forecast")],
        (F.col("forecast") - F.col("half")).alias("lower_bound"), (F.col("forecast") + F.col("half")).alias("upper_bound"),
    )


def residual_std(history: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Sample deviation of y - fitted per series."""
    return history.groupBy(*series).agg(F.stddev_samp(F.col("y") - F.col("fitted")).alias("residual_std"))


def apply_band(forecast: DataFrame, spread: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Bounds at 1.96 residual deviations."""
    half = F.lit(BAND) * F.col("residual_std")
    return join_by(forecast, spread, series, "left").withColumns(
        {"lower_bound": F.col("forecast") - half, "upper_bound": F.col("forecast") + half}
    ).drop("residual_std")


def confidence_band(forecast: DataFrame, history: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    return apply_band(forecast, residual_std(history, series), series)


def forecast_concat(history: DataFrame, future: DataFrame) -> DataFrame:
    """Fitted rows and future rows in one table, told apart by ``kind``."""
    return history.unionByName(future)


def future_tail(forecast: DataFrame, horizon: int, series: Sequence[str] = ()) -> DataFrame:
    """The last ``horizon`` periods of each series."""
    latest = Window.partitionBy(*series).orderBy(F.desc("ds"))
    return forecast.withColumn("__place", F.row_number().over(latest)).where(F.col("__place") <= horizon).drop("__place")


def plain_number(value: Column) -> Column:
    """Up to four decimals without trailing zeros, at least one decimal."""
    text = F.regexp_replace(F.format_string("%.4f", value), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def _halves(future: DataFrame, series: Sequence[str]) -> DataFrame:
    whole = Window.partitionBy(*series)
    place = F.row_number().over(whole.orderBy("ds"))
    return future.withColumns({"__early": place <= F.floor(F.count(F.lit(1)).over(whole) / 2)})


def trend_direction(future: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Second half against first half of the future rows."""
    means = _halves(future, series).groupBy(*series).agg(
        F.avg(F.when(F.col("__early"), F.col("forecast"))).alias("first"),
        F.avg(F.when(~F.col("__early"), F.col("forecast"))).alias("second"),
    )
    change = F.abs(F.col("second") - F.col("first")) / (F.abs("first") + F.lit(1e-9)) * 100
    direction = F.when(F.col("second") > F.col("first"), "Upward").otherwise("Downward")
    # A single future row has no first half, and no change that could be called small.
    strength = F.when(change < 2, "None").when(change < 5, "Weak").when(change < 15, "Moderate").otherwise("Strong")
    return means.select(*series, change.alias("pct_change"), strength.alias("trend_strength"), direction.alias("__d")).select(
        *series, "pct_change", "trend_strength",
        F.when(F.col("trend_strength") == "None", "Stable Trend")
        .otherwise(F.concat_ws(" ", "trend_strength", "__d", F.lit("Trend"))).alias("trend_direction"),
    )


def forecast_insights(future: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Mean, minimum, maximum, range text, trend and mean band width of the future rows."""
    stats = future.groupBy(*series).agg(
        F.avg("forecast").alias("m"), F.min("forecast").alias("l"), F.max("forecast").alias("h"),
        F.avg(F.col("upper_bound") - F.col("lower_bound")).alias("w"),
    )
    trend = trend_direction(future, series).drop("pct_change")
    return join_by(stats, trend, series).select(
        *series, F.round("m", 4).alias("average_forecast"), F.round("l", 4).alias("min_forecast"), F.round("h", 4).alias("max_forecast"),
        F.concat(plain_number(F.col("l")), F.lit(" — "), plain_number(F.col("h"))).alias("forecast_range"),
        "trend_direction", "trend_strength", F.round("w", 4).alias("avg_confidence_interval_width"),
    )


def forecast_table(future: DataFrame, series: Sequence[str] = (), rows: int = 10) -> DataFrame:
    """The first future rows of each series, four decimals."""
    place = F.row_number().over(Window.partitionBy(*series).orderBy("ds"))
    return future.withColumn("__place", place).where(F.col("__place") <= rows).select(
        *series, "ds", *[F.round(c, 4).alias(c) for c in ("forecast", "lower_bound", "upper_bound")]
    )


def forecast_statistics(insights: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """(statistic, value) rows as text."""
    pairs = [
        ("Minimum Forecast", plain_number(F.col("min_forecast"))),
        ("Maximum Forecast", plain_number(F.col("max_forecast"))),
        ("Average Forecast", plain_number(F.col("average_forecast"))),
        ("Trend Strength", F.concat("trend_strength", F.lit(" ("), "trend_direction", F.lit(")"))),
        ("Avg Confidence Interval Width", plain_number(F.col("avg_confidence_interval_width"))),
    ]
    return insights.select(
        *series, F.inline(F.array(*[F.struct(F.lit(k).alias("statistic"), v.alias("value")) for k, v in pairs]))
    )


def forecast_history_overlay(ts: DataFrame, future: DataFrame, series: Sequence[str] = ()) -> DataFrame:
    """Observed values and future rows in one plotting table."""
    past = ts.select(
        *series, "ds", F.lit("Historical").alias("kind"), F.col("y").alias("value"),
        F.lit(None).cast("double").alias("lower_bound"), F.lit(None).cast("double").alias("upper_bound"),
    )
    ahead = future.select(*series, "ds", F.lit("Forecast").alias("kind"), F.col("forecast").alias("value"), "lower_bound", "upper_bound")
    return past.unionByName(ahead)


NOISE = 0.05**2  # variance of an observation, in parts of the largest value squared
CHANGE_SCALE = 0.05  # of the Laplace prior of a slope change
SEASON_SCALE = 10.0  # deviation of the normal prior of a season's weights
QUANTILE = 1.2815515655446004  # normal quantile of an 80 % interval
DRAWS = 400


def sparse_fit(x, y, ridge, sparse):
    """Weights w that minimise |y - x w|^2 / 2 + sum(ridge * w^2) / 2 + sum(sparse * |w|), exactly.

    Feature-sign search (Lee et al., 2007): weights with a penalty ``sparse`` start at zero and enter one by one, the
    one of the steepest descent first; with signs held, the optimum is a linear system, and the way to it stops where a
    sign would turn, if that is lower. It ends when no weight can improve.
    """
    import numpy as np

    gram, target = x.T @ x + np.diag(ridge), x.T @ y
    w = np.zeros(len(ridge))
    sign = np.zeros(len(ridge))
    free = sparse == 0
    active = free.copy()
    cost = lambda v: 0.5 * v @ gram @ v - target @ v + sparse @ np.abs(v)
    for _ in range(50 * len(ridge)):
        rows = np.flatnonzero(active)
        best = w.copy()
        best[rows] = np.linalg.solve(gram[np.ix_(rows, rows)], (target - sparse * sign)[rows])
        turns = np.flatnonzero(active & ~free & (w * best < 0))
        options = [best] + [w + (best - w) * (w[i] / (w[i] - best[i])) for i in turns]
        for option, i in zip(options[1:], turns):
            option[i] = 0.0
        settled = not len(turns)
        w = min(options, key=cost)
        active = free | (w != 0)
        sign = np.where(free, 0.0, np.sign(w))
        if not settled:
            continue
        slope = target - gram @ w
        over = np.where(active, 0.0, np.abs(slope) - sparse)
        if over.max(initial=0.0) <= 1e-10:
            break
        j = int(over.argmax())
        active[j], sign[j] = True, np.sign(slope[j])
    return w


def sparse_fits(x, y, ridge, sparse):
    """``sparse_fit`` of many series side by side: ``x`` is series by periods by weights, ``y`` series by periods."""
    import numpy as np

    gram, target = np.einsum("bnp,bnq->bpq", x, x) + np.diag(ridge), np.einsum("bnp,bn->bp", x, y)
    w, sign = np.zeros(target.shape), np.zeros(target.shape)
    free = sparse == 0
    active = np.tile(free, (len(x), 1))
    live = np.arange(len(x))
    for _ in range(50 * len(ridge)):
        if not len(live):
            break
        on, g, t, old = active[live], gram[live], target[live], w[live]
        system = g * (on[:, :, None] & on[:, None, :])
        system[:, np.arange(len(ridge)), np.arange(len(ridge))] += ~on
        best = np.linalg.solve(system, ((t - sparse * sign[live]) * on)[:, :, None])[:, :, 0]
        row, i = np.nonzero(on & ~free & (old * best < 0))
        new, turned = best, np.zeros(len(live), bool)
        turned[row] = True
        if len(row):
            # Costs along the way from the old weights to the best ones: at its end and where a sign turns.
            way = best - old
            g_old, g_way = np.einsum("bpq,bq->bp", g, old), np.einsum("bpq,bq->bp", g, way)
            parts = [(u * v).sum(1) for u, v in ((old, g_old), (old, g_way), (way, g_way), (t, old), (t, way))]
            row, i = np.concatenate([np.flatnonzero(turned), row]), np.concatenate([np.full(turned.sum(), -1), i])
            share = np.where(i < 0, 1.0, old[row, i] / np.where(i < 0, 1.0, old[row, i] - best[row, i]))
            option = np.where(i[:, None] < 0, best[row], old[row] + way[row] * share[:, None])
            option[i >= 0, i[i >= 0]] = 0.0
            ww, wd, dd, tw, td = (c[row] for c in parts)
            cost = 0.5 * (ww + 2 * share * wd + share**2 * dd) - tw - share * td + np.abs(option) @ sparse
            order = np.lexsort((cost, row))
            first = order[np.append(True, row[order][1:] != row[order][:-1])]
            new = best.copy()
            new[row[first]] = option[first]
        on = free | (new != 0)
        w[live], active[live], sign[live] = new, on, np.where(free, 0.0, np.sign(new))
        slope = t - np.einsum("bpq,bq->bp", g, new)
        over = np.where(on, 0.0, np.abs(slope) - sparse)
        more = ~turned & (over.max(1, initial=0.0) > 1e-10)
        j = over.argmax(1)
        active[live[more], j[more]], sign[live[more], j[more]] = True, np.sign(slope[more, j[more]])
        live = live[turned | more]
    return w


def trend_seasonal_forecast(ts: DataFrame, freq: str, horizon: int, series: Sequence[str] = ()) -> DataFrame:
    """Piecewise-linear trend with yearly and, for daily data, weekly seasons.

    Slope changes have a Laplace prior, so that most of them are zero. Intervals add to the spread of the residuals that
    of future slope changes, drawn as often and as large as those of the history, and widen with the horizon.
    Rows of one period are averaged first; a series with its future periods is one row of calendar-bounded size, and
    series of one length are solved side by side.
    ``error`` tells why a series could not be fitted; it then has one row without dates.
    """
    pairs = F.sort_array(F.collect_list(F.struct("ds", F.col("y").cast("double").alias("y"))))
    rows = spread_by(per_period(ts, freq, series).groupBy(*series).agg(pairs.alias("pairs")), series, whole_groups=True).where("size(pairs) > 0")
    step = {DAILY: "make_interval(0, 0, 0, k)", WEEKLY: "make_interval(0, 0, k)", MONTHLY: "make_interval(0, k)"}[freq]
    ahead = F.expr(f"transform(sequence(1, {horizon}), k -> cast(pairs[size(pairs) - 1].ds + {step} as timestamp_ntz))")
    rows = rows.select(*series, F.concat(F.transform("pairs", lambda p: p["ds"]), ahead).alias("dates"), F.transform("pairs", lambda p: p["y"]).alias("ys"))
    days = F.transform("dates", lambda d: F.datediff(d, F.lit("1970-01-01").cast("date")).cast("double"))
    solved = rows.withColumn("st", _trend_solver(weekly=freq == DAILY)(days, "ys"))
    told = F.expr(
        "case when st.error is null then transform(dates, (d, i) -> named_struct('ds', d, 'kind', if(i < size(ys), 'fitted', 'forecast'), "
        "'forecast', st.forecast[i], 'lower_bound', st.forecast[i] - st.half[i], 'upper_bound', st.forecast[i] + st.half[i])) end"
    )
    return solved.select(*series, F.inline_outer(told), F.col("st.error").alias("error")).select(
        *series, "ds", "kind", "forecast", "lower_bound", "upper_bound", "error"
    )


def _spread_ahead(t, changes: int, size: float):
    """Variance that future slope changes add: they come at the rate of the places for them in the history, with their mean size."""
    import numpy as np

    out, later = np.zeros(len(t)), t > 1
    if size <= 0 or not later.any():
        return out
    random, beyond = np.random.RandomState(0), t[later] - 1
    count = random.poisson(changes * beyond.max(), DRAWS)
    total = int(count.sum())
    at, change = random.uniform(0, beyond.max(), total), random.laplace(0, size, total)
    if total:
        moved = change[:, None] * np.clip(beyond[None, :] - at[:, None], 0, None)
        paths = np.add.reduceat(moved, (np.cumsum(count) - count)[count > 0], axis=0)
        out[later] = (paths**2).sum(0) / DRAWS
    return out


def _trend_solver(weekly: bool):
    """Column function (days of a series and of its future, values) -> what is expected, half of the band, and why there is none."""

    @F.pandas_udf("struct<forecast array<double>, half array<double>, error string>")
    def solve(days, values):
        import numpy as np
        import pandas as pd

        out = [(None, None, "fewer than two observations")] * len(days)
        groups: dict[tuple, list[int]] = {}
        for i, (day, y) in enumerate(zip(days, values)):
            if len(y) >= 2:  # one observation a period, so that two cover more than a date
                span = day[len(y) - 1] - day[0]
                groups.setdefault((len(y), len(day), bool(span >= 730), bool(weekly and span >= 14)), []).append(i)
        for (known, length, yearly, weeks), every in groups.items():
            # Trend: intercept, slope, and slope changes spread over the first 80 % of the history.
            changes = min(25, max(0, int(known * 0.8) - 1))
            knots = np.linspace(0, 0.8, changes + 1)[1:]
            ridge, sparse = [1e-8] * 2 + [0.0] * changes, [0.0, 0.0] + [NOISE / CHANGE_SCALE] * changes
            seasons = [(365.25, 10)] * yearly + [(7.0, 3)] * weeks
            more = sum(2 * order for _, order in seasons)
            ridge, sparse = np.array(ridge + [NOISE / SEASON_SCALE**2] * more), np.array(sparse + [0.0] * more)
            at_once = max(1, min(SERIES_AT_ONCE, 4_000_000 // (length * len(ridge) + len(ridge) ** 2)))
            for own in (every[k : k + at_once] for k in range(0, len(every), at_once)):
                day = np.stack([days.iloc[i] for i in own]).astype(float)
                raw = np.stack([values.iloc[i] for i in own]).astype(float)
                t = (day - day[:, :1]) / (day[:, known - 1 : known] - day[:, :1])
                scale = np.abs(raw).max(1)
                scale[scale == 0] = 1.0
                columns = [np.ones_like(t), t, *[np.clip(t - k, 0, None) for k in knots]]
                for period, order in seasons:
                    for k in range(1, order + 1):
                        columns += [np.sin(2 * np.pi * k * day / period), np.cos(2 * np.pi * k * day / period)]
                x, y = np.stack(columns, 2), raw / scale[:, None]
                weights, singular = np.zeros((len(own), len(ridge))), np.zeros(len(own), bool)
                try:
                    weights = sparse_fits(x[:, :known], y, ridge, sparse)
                except np.linalg.LinAlgError:  # of one of them: each alone
                    for k in range(len(own)):
                        try:
                            weights[k] = sparse_fit(x[k, :known], y[k], ridge, sparse)
                        except np.linalg.LinAlgError:
                            singular[k] = True
                forecast = np.einsum("bnp,bp->bn", x, weights) * scale[:, None]
                variance = (raw - forecast[:, :known]).var(1, ddof=1)
                size = np.abs(weights[:, 2 : 2 + changes]).mean(1) * scale if changes else np.zeros(len(own))
                for k, i in enumerate(own):
                    if singular[k]:
                        out[i] = (None, None, "singular system")
                    else:
                        out[i] = (forecast[k], QUANTILE * np.sqrt(variance[k] + _spread_ahead(t[k], changes, size[k])), None)
        return pd.DataFrame(out, columns=["forecast", "half", "error"])

    return solve
