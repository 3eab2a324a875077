"""Regular time series from rows: frequency, resampling, calendar grids.

Rows are combined into calendar periods first, with partial sums before the
shuffle. What is windowed afterwards is one row per series and period, which
the calendar bounds whatever the number of rows behind it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.columns import as_double, as_timestamp, quoted
from ..functions.quantiles import grouped_median

DAILY, WEEKLY, MONTHLY = "D", "W", "MS"
SAMPLE_DATES = 100

AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "count": F.count,
    "std": F.stddev_samp, "var": F.var_samp, "nunique": F.count_distinct, "size": F.count, "prod": F.product,
    "first": lambda y: F.min_by(y, F.struct("at", y)), "last": lambda y: F.max_by(y, F.struct("at", y)),
}
# What these aggregates give for a period without rows, which then counts as a value.
EMPTY = {"sum": 0.0, "count": 0.0, "nunique": 0.0, "size": 0.0, "prod": 1.0}


def bucket(ds: Column, freq: str) -> Column:
    """Label of the period: the day, the Sunday that ends the week, or the first of the month."""
    if freq == DAILY:
        return F.date_trunc("day", ds).cast("timestamp_ntz")
    if freq == WEEKLY:
        return (F.date_trunc("week", ds) + F.expr("INTERVAL 6 DAYS")).cast("timestamp_ntz")
    if freq == MONTHLY:
        return F.date_trunc("month", ds).cast("timestamp_ntz")
    raise ValueError(f"unknown frequency {freq!r}")


def step(freq: str) -> Column:
    return F.expr({DAILY: "INTERVAL 1 DAY", WEEKLY: "INTERVAL 7 DAYS", MONTHLY: "INTERVAL 1 MONTH"}[freq])


def _observations(df: DataFrame, date: str, target: str | None, series: Sequence[str], formats) -> DataFrame:
    columns = [*[quoted(s) for s in series], as_timestamp(df, date, formats).alias("ds")]
    if target is not None:
        columns.append(as_double(df, target).alias("y"))
    return df.select(*columns).dropna(subset=["ds", "y"] if target is not None else ["ds"])


def _frequency_of(days: Column) -> Column:
    return F.when(days >= 25, MONTHLY).when(days >= 5, WEEKLY).otherwise(DAILY)


def detect_frequency(df: DataFrame, date: str, series: Sequence[str] = (), formats: list[str] | None = None) -> DataFrame:
    """Frequency code per series.

    Even spacing of the first 100 distinct dates decides; otherwise the median
    time between consecutive rows does, in whole days; rows on one day count as 0 apart.
    """
    days = _observations(df, date, None, series, formats).groupBy(*series, F.to_date("ds").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.min("ds").alias("begin"), F.max("ds").alias("end")
    )
    along = Window.partitionBy(*series).orderBy("day")
    seconds = lambda c: c.cast("timestamp").cast("double")
    gaps = days.select(
        *series, "day", "n", F.row_number().over(along).alias("place"), F.datediff("day", F.lag("day").over(along)).alias("gap"),
        ((seconds(F.col("begin")) - seconds(F.lag("end").over(along))) / 86_400).alias("elapsed"),
    )
    early = F.col("place") <= SAMPLE_DATES
    month_start = F.dayofmonth("day") == 1
    month_end = F.col("day") == F.last_day("day")
    # Gaps between rows: one per later day, and one of zero length for each further row of a day.
    weighted = gaps.select(
        *series, "place", "day",
        F.when(early, F.col("gap")).alias("early_gap"),
        F.when(early, month_start).alias("starts"),
        F.when(early, month_end).alias("ends"),
        F.inline(
            F.array(
                F.struct(F.col("elapsed").alias("length"), F.lit(1).cast("long").alias("weight")),
                F.struct(F.lit(0.0).alias("length"), (F.col("n") - 1).alias("weight")),
            )
        ),
    )
    facts = weighted.groupBy(*series).agg(
        F.count_distinct(F.when(F.col("place") <= SAMPLE_DATES, F.col("place"))).alias("dates"),
        F.min("early_gap").alias("low"), F.max("early_gap").alias("high"),
        F.bool_and("starts").alias("starts"), F.bool_and("ends").alias("ends"),
        F.percentile(F.col("length"), 0.5, F.coalesce(F.when(F.col("length").isNotNull(), F.col("weight")), F.lit(0))).alias("median_gap"),
    )
    even = (F.col("dates") >= 3) & (
        (F.col("low") == F.col("high")) | ((F.col("starts") | F.col("ends")) & (F.col("low") >= 28) & (F.col("high") <= 31))
    )
    decided = F.when(even, _frequency_of(F.col("low"))).otherwise(_frequency_of(F.floor(F.coalesce("median_gap", F.lit(0.0)))))
    return facts.select(*series, decided.alias("frequency"))


def resample(
    df: DataFrame, date: str, target: str, freq: str, aggregate: str = "mean", series: Sequence[str] = (),
    formats: list[str] | None = None,
) -> DataFrame:
    """(series, ds, y): one row per period with a value.

    For sums, products and counts a period without rows has one too (0, or 1 for
    a product), from the first period of the series to its last.
    """
    if aggregate not in AGGREGATES and aggregate != "median":
        raise ValueError(f"unknown aggregate {aggregate!r}")
    rows = _observations(df, date, target, series, formats)
    if aggregate == "median":
        labelled = rows.withColumn("ds", bucket(F.col("ds"), freq))
        return grouped_median(labelled, [*series, "ds"], "y").withColumnRenamed("median", "y")
    labelled = rows.select(*series, bucket(F.col("ds"), freq).alias("ds"), F.col("ds").alias("at"), "y")
    found = labelled.groupBy(*series, "ds").agg(AGGREGATES[aggregate](F.col("y")).cast("double").alias("y")).where("y is not null")
    return with_gaps(found, freq, EMPTY[aggregate], series) if aggregate in EMPTY else found


def with_gaps(ts: DataFrame, freq: str, value: float, series: Sequence[str] = ()) -> DataFrame:
    """Every period between a series' first and last; those without a row have ``value``.

    A row makes the periods up to the next one of its series, so that the calendar is neither joined nor sorted.
    """
    known = ts.withColumn("__next", F.lead("ds").over(Window.partitionBy(*series).orderBy("ds")))
    periods = F.when(F.col("__next").isNull(), F.array("ds")).otherwise(F.sequence("ds", (F.col("__next") - step(freq)).cast("timestamp_ntz"), step(freq)))
    filled = known.select(*[quoted(s) for s in series], F.posexplode(periods).alias("__place", "ds"), "y")
    return filled.select(*[quoted(s) for s in series], "ds", F.when(F.col("__place") == 0, F.col("y")).otherwise(F.lit(value)).alias("y"))


def resample_daily(df, date, target, series=()):
    return resample(df, date, target, DAILY, "mean", series)


def resample_weekly(df, date, target, series=()):
    return resample(df, date, target, WEEKLY, "mean", series)


def resample_monthly(df, date, target, series=()):
    return resample(df, date, target, MONTHLY, "mean", series)


def prepare_time_series(
    df: DataFrame, date: str, target: str, freq: str | None = None, aggregate: str = "mean", series: Sequence[str] = (),
    formats: list[str] | None = None,
) -> DataFrame:
    """Project, parse, drop missing, resample. Without ``freq`` the whole table decides it."""
    if freq is None:
        found = detect_frequency(df.where(quoted(target).isNotNull()), date, (), formats).first()
        freq = found["frequency"] if found else DAILY
    return resample(df, date, target, freq, aggregate, series, formats).orderBy(*series, "ds")


def per_period(ts: DataFrame, freq: str, series: Sequence[str] = ()) -> DataFrame:
    """One mean per series and period, so that a series is no longer than the calendar; a resampled table stays as it is."""
    return ts.groupBy(*series, bucket(F.col("ds"), freq).alias("ds")).agg(F.avg(F.col("y").cast("double")).alias("y")).where("y is not null")


def regular_grid_ffill(ts: DataFrame, freq: str, series: Sequence[str] = ()) -> DataFrame:
    """Every period between a series' first and last, gaps filled with the value before."""
    span = ts.groupBy(*series).agg(F.min("ds").alias("first"), F.max("ds").alias("last")).where("first is not null")
    grid = span.select(*series, F.explode(F.sequence("first", "last", step(freq))).alias("ds"))
    before = Window.partitionBy(*series).orderBy("ds").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return grid.join(ts, [*series, "ds"], "left").select(*series, "ds", F.last("y", ignorenulls=True).over(before).alias("y"))


def future_dates(ts: DataFrame, freq: str, horizon: int, series: Sequence[str] = ()) -> DataFrame:
    """The ``horizon`` periods after each series' last one, numbered from 1."""
    last = ts.groupBy(*series).agg(F.max("ds").alias("last")).where("last is not null")
    steps = F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step")
    ahead = {
        DAILY: "last + make_interval(0, 0, 0, step)",
        WEEKLY: "last + make_interval(0, 0, step)",
        MONTHLY: "last + make_interval(0, step)",
    }[freq]
    return last.select(*series, "last", steps).select(*series, "step", F.expr(ahead).cast("timestamp_ntz").alias("ds"))

