"""Registered queries: time series and forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import forecast as G, timeseries as S
from ..plans.forecasting import forecast_engine_fallback
from .base import query, r, rounded

SERIES = ["o_orderpriority"]
BUCKETS = {"D": "date_trunc('day', o_orderdate)", "W": "date_trunc('week', o_orderdate) + interval 6 day", "MS": "date_trunc('month', o_orderdate)"}


def resample_sql(freq: str, agg: str = "avg", series: bool = True, y: str = "o_totalprice") -> str:
    key = "o_orderpriority, " if series else ""
    return f"select {key}cast({BUCKETS[freq]} as timestamp) as ds, cast({agg}({y}) as double) as y from orders group by all"


def rounded_sql(sql: str, columns: str = "o_orderpriority, ds") -> str:
    return f"select {columns}, {r('y')} as y from ({sql})"


def orders_series(t, freq, aggregate="mean"):
    return S.resample(t.orders, "o_orderdate", "o_totalprice", freq, aggregate, SERIES)


@query(
    "detect_frequency",
    "with d as (select event_type, cast(ts as date) as day, count(*) as n, min(ts) as b, max(ts) as e from events group by 1, 2), "
    "g as (select *, row_number() over p as place, datediff('day', lag(day) over p, day) as gap, (epoch(b) - epoch(lag(e) over p)) / 86400 as apart "
    "from d window p as (partition by event_type order by day)), "
    "w as (select event_type, apart from g where apart is not null union all select event_type, 0 from (select *, unnest(range(n - 1)) from g)), "
    "v as (select event_type, count(*) >= 3 and min(gap) = max(gap) as even, min(gap) as low from g where place <= 100 group by 1), "
    "m as (select event_type, median(apart) as med from w group by 1) "
    "select event_type, case when x >= 25 then 'MS' when x >= 5 then 'W' else 'D' end as frequency from "
    "(select v.event_type, case when even then low else floor(coalesce(med, 0)) end as x from v left join m on m.event_type = v.event_type)",
)
def _(t):
    return S.detect_frequency(t.events, "ts", ["event_type"])


@query(
    "detect_frequency_gaps",
    "with d as (select o_custkey, cast(o_orderdate as date) as day, count(*) as n from orders group by 1, 2), "
    "g as (select *, row_number() over (partition by o_custkey order by day) as place, "
    "datediff('day', lag(day) over (partition by o_custkey order by day), day) as gap from d), "
    "w as (select o_custkey, gap from g where gap is not null union all select o_custkey, 0 from (select *, unnest(range(n - 1)) from g)), "
    "e as (select o_custkey, count(*) >= 3 and min(gap) = max(gap) as even, min(gap) as low from g where place <= 100 group by 1), "
    "m as (select o_custkey, median(gap) as med from w group by 1) "
    "select o_custkey, case when x >= 25 then 'MS' when x >= 5 then 'W' else 'D' end as frequency from "
    "(select e.o_custkey, case when even then low else coalesce(med, 0) end as x from e left join m on m.o_custkey = e.o_custkey)",
)
def _(t):
    return S.detect_frequency(t.orders, "o_orderdate", ["o_custkey"])


@query("prepare_time_series", rounded_sql(resample_sql("D", series=False), "ds"))
def _(t):
    return rounded(S.prepare_time_series(t.orders, "o_orderdate", "o_totalprice"))


@query("resample_daily", rounded_sql(resample_sql("D")))
def _(t):
    return rounded(S.resample_daily(t.orders, "o_orderdate", "o_totalprice", SERIES))


@query("resample_weekly", rounded_sql(resample_sql("W")))
def _(t):
    return rounded(S.resample_weekly(t.orders, "o_orderdate", "o_totalprice", SERIES))


@query("resample_monthly", rounded_sql(resample_sql("MS")))
def _(t):
    return rounded(S.resample_monthly(t.orders, "o_orderdate", "o_totalprice", SERIES))


# Aggregate: its SQL, and the value of a period without orders; customers have gaps of months.
RESAMPLE_AGGREGATES = {
    "sum": ("sum(o_totalprice)", "0"), "count": ("count(o_totalprice)", "0"), "nunique": ("count(distinct o_totalprice)", "0"),
    "size": ("count(*)", "0"), "prod": ("product(o_shippriced)", "1"), "min": ("min(o_totalprice)", None), "max": ("max(o_totalprice)", None),
    "median": ("median(o_totalprice)", None), "first": ("arg_min(o_totalprice, (o_orderdate, o_totalprice))", None),
    "last": ("arg_max(o_totalprice, (o_orderdate, o_totalprice))", None),
}


def gaps_sql(name: str) -> str:
    agg, empty = RESAMPLE_AGGREGATES[name]
    found = f"select o_custkey, cast({BUCKETS['MS']} as timestamp) as ds, cast({agg.replace('o_shippriced', '(1 + o_totalprice / 1000000)')} as double) as y from orders group by all"
    if empty is None:
        return f"select '{name}' as aggregate, o_custkey, ds, {r('y', 4)} as y from ({found})"
    return (
        f"select '{name}' as aggregate, o_custkey, g.ds, {r(f'coalesce(y, {empty})', 4)} as y from (select o_custkey, unnest(generate_series(min(ds), max(ds), "
        f"interval 1 month)) as ds from ({found}) group by 1) g left join ({found}) f using (o_custkey, ds)"
    )


@query("resample_agg", " union all ".join(gaps_sql(a) for a in RESAMPLE_AGGREGATES))
def _(t):
    from ..functions.tables import union_all

    orders = t.orders.withColumn("factor", 1 + F.col("o_totalprice") / 1000000)
    parts = [
        S.resample(orders, "o_orderdate", "factor" if a == "prod" else "o_totalprice", "MS", a, ["o_custkey"])
        .select(F.lit(a).alias("aggregate"), "o_custkey", "ds", "y") for a in RESAMPLE_AGGREGATES
    ]
    return rounded(union_all(parts), 4)


GRID_SQL = (
    "ts as ({ts}), span as (select o_orderpriority, min(ds) as lo, max(ds) as hi from ts group by 1), "
    "grid as (select o_orderpriority, unnest(generate_series(lo, hi, interval {step})) as ds from span), "
    "g as (select grid.o_orderpriority, grid.ds, last_value(y ignore nulls) over (partition by grid.o_orderpriority order by grid.ds) as y "
    "from grid left join ts on ts.o_orderpriority = grid.o_orderpriority and ts.ds = grid.ds)"
)


@query("regular_grid_ffill", f"with {GRID_SQL.format(ts=resample_sql('D'), step='1 day')} select o_orderpriority, ds, {r('y')} as y from g")
def _(t):
    return rounded(S.regular_grid_ffill(orders_series(t, "D"), "D", SERIES))


@query(
    "future_dates",
    f"with ts as ({resample_sql('MS')}), l as (select o_orderpriority, max(ds) as hi from ts group by 1) "
    "select o_orderpriority, cast(k as int) as step, hi + to_months(cast(k as int)) as ds from l, (select unnest(range(1, 31)) as k)",
)
def _(t):
    return S.future_dates(orders_series(t, "MS"), "MS", 30, SERIES)


# Holt-Winters on monthly means: the same recursion as a recursive CTE over every weight triple.
WEIGHTS = ([0.1, 0.3, 0.5, 0.7, 0.9], [0.01, 0.1, 0.3], [0.05, 0.2, 0.4])
HORIZON = 6
HW_SQL = (
    f"with recursive {GRID_SQL.format(ts=resample_sql('MS'), step='1 month')}, "
    "n as (select *, row_number() over (partition by o_orderpriority order by ds) as i from g), "
    "seed as (select o_orderpriority, avg(y) filter (i <= 12) as m1, avg(y) filter (i between 13 and 24) as m2, "
    "list(y order by i) filter (i <= 12) as s from n group by 1), "
    f"w as (select cast(al as double) as al, cast(be as double) as be, cast(ga as double) as ga from (select unnest({WEIGHTS[0]}) as al), "
    f"(select unnest({WEIGHTS[1]}) as be), (select unnest({WEIGHTS[2]}) as ga)), "
    "f(o_orderpriority, al, be, ga, i, l, b, s, fitted, y, sse) as (select o_orderpriority, al, be, ga, cast(0 as bigint), m1 - (m2 - m1) / 12, (m2 - m1) / 12, "
    "list_transform(s, lambda v: v - m1), 0.0::double, 0.0::double, 0.0::double from seed, w union all "
    "select o_orderpriority, al, be, ga, i, nl, be * (nl - l) + (1 - be) * b, list_append(s[2:], ga * (y - nl) + (1 - ga) * s[1]), "
    "l + b + s[1], y, sse + pow(y - (l + b + s[1]), 2) from (select f.o_orderpriority, al, be, ga, n.i, f.l, f.b, f.s, n.y, f.sse, "
    "al * (n.y - f.s[1]) + (1 - al) * (f.l + f.b) as nl from f join n on n.o_orderpriority = f.o_orderpriority and n.i = f.i + 1)), "
    "cnt as (select o_orderpriority, max(i) as n, max(ds) as last from n group by 1), "
    "ends as (select f.*, cnt.last from f join cnt on cnt.o_orderpriority = f.o_orderpriority and cnt.n = f.i), "
    "best as (select *, row_number() over (partition by o_orderpriority order by sse, al, be, ga) as k from ends), "
    "sd as (select b.o_orderpriority, stddev_samp(f.y - f.fitted) as sd from best b join f on b.k = 1 and f.i > 0 and "
    "f.o_orderpriority = b.o_orderpriority and f.al = b.al and f.be = b.be and f.ga = b.ga group by 1), "
    "out as (select f.o_orderpriority, n.ds, 'fitted' as kind, f.fitted as forecast from f join best b on b.k = 1 and f.i > 0 and "
    "f.o_orderpriority = b.o_orderpriority and f.al = b.al and f.be = b.be and f.ga = b.ga join n on n.o_orderpriority = f.o_orderpriority and n.i = f.i "
    "union all select o_orderpriority, last + to_months(cast(h as int)), 'forecast', l + h * b + s[((h - 1) % 12) + 1] from best, "
    f"(select unnest(range(1, {HORIZON + 1})) as h) where k = 1) "
    f"select out.o_orderpriority, cast(ds as timestamp) as ds, kind, {r('forecast', 4)} as forecast, {r('forecast - 1.96 * sd', 4)} as lower_bound, "
    f"{r('forecast + 1.96 * sd', 4)} as upper_bound from out join sd on sd.o_orderpriority = out.o_orderpriority"
)


@query("holt_winters", HW_SQL)
def _(t):
    return rounded(G.holt_winters(orders_series(t, "MS"), "MS", HORIZON, SERIES, WEIGHTS), 4)


TREND_SQL = (
    "with recursive ts as (select event_type, cast(date_trunc('week', ts) + interval 6 day as timestamp) as ds, avg(value) as y from events group by 1, 2), "
    "n as (select *, row_number() over (partition by event_type order by ds) as i from ts), "
    "f(event_type, i, l, b, fitted) as (select event_type, cast(0 as bigint), 2 * max(y) filter (i = 1) - max(y) filter (i = 2), "
    "max(y) filter (i = 2) - max(y) filter (i = 1), 0.0::double from n group by 1 union all "
    "select event_type, i, nl, 0.1 * (nl - l) + 0.9 * b, l + b from (select f.event_type, n.i, f.l, f.b, 0.5 * n.y + 0.5 * (f.l + f.b) as nl "
    "from f join n on n.event_type = f.event_type and n.i = f.i + 1)), "
    "e as (select event_type, max(i) as k from f group by 1), hi as (select event_type, max(ds) as last from ts group by 1) "
    f"select n.event_type, n.ds, 'fitted' as kind, {r('fitted')} as forecast from f join n on n.event_type = f.event_type and n.i = f.i union all "
    f"select f.event_type, last + to_days(cast(7 * h as int)), 'forecast', {r('l + h * b')} from f join e on e.event_type = f.event_type and e.k = f.i "
    "join hi on hi.event_type = f.event_type, (select unnest(range(1, 8)) as h)"
)


@query("holt_winters_trend", TREND_SQL)
def _(t):
    # Five weeks of events: too short for a yearly season, so level and trend only.
    ts = S.resample_weekly(t.events, "ts", "value", ["event_type"])
    out = G.holt_winters(ts, "W", 7, ["event_type"], ([0.5], [0.1], [0.0]))
    return rounded(out.select("event_type", "ds", "kind", "forecast"))


@query("trend_seasonal_forecast")
def _(t):
    return G.trend_seasonal_forecast(orders_series(t, "D"), "D", 30, SERIES)


@query(
    "trend_seasonal_periods",
    "with h as (select o_orderpriority, cast(o_orderdate as date) as day from orders group by 1, 2), l as (select o_orderpriority, max(day) as last from h group by 1) "
    "select o_orderpriority, cast(day as timestamp) as ds, 'fitted' as kind, true as inside from h union all "
    "select o_orderpriority, cast(last + cast(k as int) as timestamp), 'forecast', true from l, (select unnest(range(1, 31)) as k)",
)
def _(t):
    """Periods and kinds of the forecast, and whether the forecast lies between its bounds."""
    out = G.trend_seasonal_forecast(orders_series(t, "D"), "D", 30, SERIES)
    return out.select(*SERIES, "ds", "kind", ((F.col("lower_bound") < F.col("forecast")) & (F.col("forecast") < F.col("upper_bound"))).alias("inside"))


@query("forecast_engine_fallback")
def _(t):
    ts = S.resample(t.orders, "o_orderdate", "o_totalprice", "MS", "mean", ["o_custkey"])
    return forecast_engine_fallback(ts, "MS", 7, ["o_custkey"])


# A fixed forecast both engines can state: the series mean with a step per period.
NAIVE_SQL = (
    f"ts as ({resample_sql('MS')}), hist as (select *, avg(y) over (partition by o_orderpriority) as fitted from ts), "
    "last as (select o_orderpriority, max(ds) as hi, avg(y) as m from ts group by 1), "
    "fut as (select o_orderpriority, hi + to_months(cast(k as int)) as ds, m + k * 700.0 as forecast from last, (select unnest(range(1, 31)) as k)), "
    "sd as (select o_orderpriority, stddev_samp(y - fitted) as sd from hist group by 1), "
    "band as (select fut.*, forecast - 1.96 * sd as lower_bound, forecast + 1.96 * sd as upper_bound from fut join sd on sd.o_orderpriority = fut.o_orderpriority)"
)


def naive_history(t):
    ts = orders_series(t, "MS")
    means = ts.groupBy(*SERIES).agg(F.avg("y").alias("fitted"))
    return ts.join(means, SERIES)


def naive_future(t):
    means = orders_series(t, "MS").groupBy(*SERIES).agg(F.avg("y").alias("m"))
    ahead = S.future_dates(orders_series(t, "MS"), "MS", 30, SERIES)
    return ahead.join(means, SERIES).select(*SERIES, "ds", (F.col("m") + F.col("step") * 700.0).alias("forecast"))


def naive_band(t):
    return G.confidence_band(naive_future(t), naive_history(t), SERIES)


BAND_COLUMNS = f"{r('forecast', 4)} as forecast, {r('lower_bound', 4)} as lower_bound, {r('upper_bound', 4)} as upper_bound"


@query("confidence_band", f"with {NAIVE_SQL} select o_orderpriority, ds, {BAND_COLUMNS} from band")
def _(t):
    return rounded(naive_band(t), 4)


@query(
    "forecast_concat",
    f"with {NAIVE_SQL} select o_orderpriority, ds, 'fitted' as kind, {r('fitted')} as forecast from hist union all "
    f"select o_orderpriority, ds, 'forecast', {r('forecast')} from fut",
)
def _(t):
    history = naive_history(t).select(*SERIES, "ds", F.lit("fitted").alias("kind"), F.col("fitted").alias("forecast"))
    future = naive_future(t).select(*SERIES, "ds", F.lit("forecast").alias("kind"), "forecast")
    return rounded(G.forecast_concat(history, future))


@query(
    "future_tail",
    f"with {NAIVE_SQL} select o_orderpriority, ds, {r('forecast')} as forecast from fut "
    "qualify row_number() over (partition by o_orderpriority order by ds desc) <= 7",
)
def _(t):
    return rounded(G.future_tail(naive_future(t), 7, SERIES))


TREND_FACTS = (
    "halves as (select o_orderpriority, avg(forecast) filter (k <= n // 2) as f1, avg(forecast) filter (k > n // 2) as f2 from "
    "(select *, row_number() over (partition by o_orderpriority order by ds) as k, count(*) over (partition by o_orderpriority) as n from fut) group by 1), "
    "chg as (select o_orderpriority, abs(f2 - f1) / (abs(f1) + 1e-9) * 100 as pct_change, case when f2 > f1 then 'Upward' else 'Downward' end as d from halves), "
    "trend as (select o_orderpriority, pct_change, case when pct_change < 2 then 'None' when pct_change < 5 then 'Weak' when pct_change < 15 then 'Moderate' else 'Strong' end as trend_strength, "
    "case when pct_change < 2 then 'Stable Trend' when pct_change < 5 then 'Weak ' || d || ' Trend' when pct_change < 15 then 'Moderate ' || d || ' Trend' else 'Strong ' || d || ' Trend' end as trend_direction from chg)"
)


@query("trend_direction", f"with {NAIVE_SQL}, {TREND_FACTS} select o_orderpriority, {r('pct_change')} as pct_change, trend_strength, trend_direction from trend")
def _(t):
    return rounded(G.trend_direction(naive_future(t), SERIES))


def number_sql(x: str) -> str:
    return f"regexp_replace(regexp_replace(printf('%.4f', {x}), '0+$', ''), '[.]$', '.0')"


INSIGHTS_SQL = (
    f"{NAIVE_SQL}, {TREND_FACTS}, st as (select o_orderpriority, avg(forecast) as m, min(forecast) as l, max(forecast) as h, "
    "avg(upper_bound - lower_bound) as w from band group by 1), "
    f"ins as (select st.o_orderpriority, {r('m', 4)} as average_forecast, {r('l', 4)} as min_forecast, {r('h', 4)} as max_forecast, "
    f"{number_sql('l')} || ' — ' || {number_sql('h')} as forecast_range, trend_direction, trend_strength, {r('w', 4)} as avg_confidence_interval_width "
    "from st join trend on trend.o_orderpriority = st.o_orderpriority)"
)


@query("forecast_insights", f"with {INSIGHTS_SQL} select * from ins")
def _(t):
    return rounded(G.forecast_insights(naive_band(t), SERIES), 4)


@query(
    "forecast_table",
    f"with {NAIVE_SQL} select o_orderpriority, ds, {BAND_COLUMNS} from band qualify row_number() over (partition by o_orderpriority order by ds) <= 10",
)
def _(t):
    return rounded(G.forecast_table(naive_band(t), SERIES), 4)


@query(
    "forecast_statistics",
    f"with {INSIGHTS_SQL} "
    + " union all ".join(
        f"select o_orderpriority, '{k}' as statistic, {v} as value from ins"
        for k, v in [
            ("Minimum Forecast", number_sql("min_forecast")), ("Maximum Forecast", number_sql("max_forecast")),
            ("Average Forecast", number_sql("average_forecast")), ("Trend Strength", "trend_strength || ' (' || trend_direction || ')'"),
            ("Avg Confidence Interval Width", number_sql("avg_confidence_interval_width")),
        ]
    ),
)
def _(t):
    return G.forecast_statistics(G.forecast_insights(naive_band(t), SERIES), SERIES)


@query(
    "forecast_history_overlay",
    f"with {NAIVE_SQL} select o_orderpriority, ds, 'Historical' as kind, {r('y', 4)} as value, null as lower_bound, null as upper_bound from ts union all "
    f"select o_orderpriority, ds, 'Forecast', {r('forecast', 4)}, {r('lower_bound', 4)}, {r('upper_bound', 4)} from band",
)
def _(t):
    return rounded(G.forecast_history_overlay(orders_series(t, "MS"), naive_band(t), SERIES), 4)
