"""Mean percentage change by day of week or hour of day."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import at, day_of_week, hours, period_label, rounded, safe_div, trunc_ntz
from .scope import series

PERIODS = {"day": 7, "hour": 24}


def changes(candles: DataFrame, kind: str, as_of: str | Column, lookback_hours: int) -> DataFrame:
    """symbol, start of period, change in percent of the period's last close.

    Periods run from the one of ``as_of`` minus the lookback to the unfinished one of ``as_of``, both whole.
    """
    if kind not in PERIODS:
        raise ValueError(f"period must be one of {sorted(PERIODS)}, not {kind!r}")
    start = F.date_trunc(kind, at(as_of) - hours(lookback_hours)).cast("timestamp_ntz")
    end = F.date_trunc(kind, at(as_of)).cast("timestamp_ntz") + F.expr(f"INTERVAL 1 {kind.upper()}")
    kept = candles.where((F.col("start_time") >= start) & (F.col("start_time") < end))
    whole = kept.groupBy(*series(candles), trunc_ntz(kind, F.col("start_time")).alias("period_start")).agg(
        F.min_by("open", "start_time").cast("double").alias("first_open"), F.max_by("close", "start_time").cast("double").alias("last_close")
    )
    change = safe_div(F.col("last_close") - F.col("first_open"), F.col("last_close"), F.col("last_close") != 0, None) * 100
    return whole.select(*series(candles), "period_start", change.alias("change")).where("change is not null")


def seasonality(candles: DataFrame, kind: str, as_of: str | Column, lookback_hours: int, digits: int = 2) -> DataFrame:
    """symbol, period, label, value, positive: all 7 or 24 periods of each symbol, 0 where one has no data."""
    period = day_of_week(F.col("period_start")) if kind == "day" else F.hour("period_start").cast("bigint")
    mean = changes(candles, kind, as_of, lookback_hours).groupBy(*series(candles), period.alias("period")).agg(F.avg("change").alias("mean"))
    every = candles.select(*series(candles)).distinct().select(*series(candles), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(PERIODS[kind] - 1).cast("bigint"))).alias("period"))
    value = F.coalesce("mean", F.lit(0.0))
    return every.join(mean, [*series(candles), "period"], "left").select(*series(candles), "period", period_label(kind, F.col("period")).alias("label"), rounded(value, digits).alias("value"), (value > 0).alias("positive"))
