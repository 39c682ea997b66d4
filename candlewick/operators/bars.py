"""Candles: aggregation from ticks, the measures, unpivoting, the dense grid and its fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import MEASURES
from ..functions.scalar import at, trunc_ntz
from .scope import scope, series

STEP = {"minute": "INTERVAL 1 MINUTE", "hour": "INTERVAL 1 HOUR", "day": "INTERVAL 1 DAY"}


def bars(ticks: DataFrame, unit: str = "hour", symbol: str = "event_type", time: str = "ts", value: str = "value", tie: str = "event_id") -> DataFrame:
    """One candle for each symbol (of each market) and period with ticks; the first and last tick by time, ties by ``tie``."""
    order = F.struct(time, tie)
    return ticks.groupBy(*scope(ticks), F.col(symbol).alias("symbol"), trunc_ntz(unit, F.col(time)).alias("start_time")).agg(
        F.min_by(value, order).alias("open"),
        F.max(value).alias("high"),
        F.min(value).alias("low"),
        F.max_by(value, order).alias("close"),
        F.sum(value).alias("base_volume"),
        F.count(F.lit(1)).alias("number_of_trades"),
    )


def between(candles: DataFrame, start: str | Column, end: str | Column) -> DataFrame:
    """The half-open range of start times."""
    return candles.where((F.col("start_time") >= at(start)) & (F.col("start_time") < at(end)))


def measure(candles: DataFrame, name: str) -> DataFrame:
    """symbol, start_time, value of one measure; an unknown measure has only nulls."""
    value = F.col(MEASURES[name]).cast("double") if name in MEASURES else F.lit(None).cast("double")
    return candles.select(*series(candles), "start_time", value.alias("value"))


def unpivot(candles: DataFrame, measures: list[str] | None = None) -> DataFrame:
    """symbol, start_time, measure, value: a row for each measure."""
    rows = [F.struct(F.lit(m).alias("measure"), F.col(MEASURES[m]).cast("double").alias("value")) for m in measures or MEASURES]
    return candles.select(*series(candles), "start_time", F.explode(F.array(*rows)).alias("m")).select(*series(candles), "start_time", "m.measure", "m.value")


def grid(symbols: DataFrame, start: str | Column, end: str | Column, unit: str = "hour") -> DataFrame:
    """Each symbol with each step in [start, end); made inside the symbol's task, no join."""
    step = F.expr(STEP[unit])
    return symbols.select(*series(symbols)).distinct().select(*series(symbols), F.explode(F.sequence(at(start), at(end) - step, step)).alias("start_time"))


def on_grid(candles: DataFrame, start: str | Column, end: str | Column, unit: str = "hour") -> DataFrame:
    """``candles`` on the dense grid of their symbols; null where a symbol has no candle."""
    kept = between(candles, start, end)
    return grid(kept, start, end, unit).join(kept, [*series(kept), "start_time"], "left")


def filled(gridded: DataFrame, columns: list[str], keys: list[str] | None = None, back: bool = True) -> DataFrame:
    """Missing values take the last one before, leading ones the first one after (unless ``back`` is off)."""
    by = Window.partitionBy(*(keys or series(gridded))).orderBy("start_time")
    before, after = by.rowsBetween(Window.unboundedPreceding, 0), by.rowsBetween(0, Window.unboundedFollowing)
    fill = {c: F.coalesce(F.last(c, True).over(before), F.first(c, True).over(after)) if back else F.last(c, True).over(before) for c in columns}
    return gridded.withColumns(fill)


def synthetic(candles: DataFrame, start: str | Column, end: str | Column, unit: str = "hour") -> DataFrame:
    """A flat candle at the last close, without volume or trades, for each step where a known symbol is silent."""
    dense = on_grid(candles, start, end, unit)
    last = F.last("close", True).over(Window.partitionBy(*series(candles)).orderBy("start_time").rowsBetween(Window.unboundedPreceding, 0))
    flat = dense.withColumn("last_close", last).where("last_close is not null")
    price = {c: F.coalesce(c, "last_close") for c in ("open", "high", "low", "close")}
    return flat.withColumns({**price, "is_synthetic": F.col("number_of_trades").isNull(), "base_volume": F.coalesce("base_volume", F.lit(0.0)), "number_of_trades": F.coalesce("number_of_trades", F.lit(0))}).drop("last_close")
