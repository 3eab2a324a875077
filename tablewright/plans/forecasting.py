"""Primary forecast engine with a fallback, per series."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions.tables import join_by
from ..operators.forecast import holt_winters, trend_seasonal_forecast
from ..session import stage

PRIMARY, FALLBACK = "Trend and seasons", "Holt-Winters"


def forecast_engine_fallback(ts: DataFrame, freq: str, horizon: int, series: Sequence[str] = ()) -> DataFrame:
    """Forecast rows of the primary engine, of the fallback where it failed.

    A series that neither can fit keeps one row with both reasons in ``error``.
    """
    primary = stage(trend_seasonal_forecast(ts, freq, horizon, series), "primary-forecast")
    done = primary.where("error is null").withColumn("engine", F.lit(PRIMARY))
    failed = primary.where("error is not null").select(*series, F.col("error").alias("primary_error"))
    again = join_by(ts, failed, series)
    second = stage(
        holt_winters(again.drop("primary_error"), freq, horizon, series, search=True).withColumns(
            {"error": F.lit(None).cast("string"), "engine": F.lit(FALLBACK)}
        ),
        "fallback-forecast",
    )
    saved = second.select(*series, F.lit(True).alias("saved")).distinct()
    lost = join_by(failed, saved, series, "left").where("saved is null")
    reason = F.concat(F.lit(f"{PRIMARY}: "), "primary_error", F.lit(f"; {FALLBACK}: fewer than two periods"))
    nothing = lost.select(
        *series, F.lit(None).cast("timestamp_ntz").alias("ds"), F.lit(None).cast("string").alias("kind"),
        *[F.lit(None).cast("double").alias(c) for c in ("forecast", "lower_bound", "upper_bound")],
        reason.alias("error"), F.lit(None).cast("string").alias("engine"),
    )
    return done.unionByName(second).unionByName(nothing)
