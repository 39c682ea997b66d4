"""Gaps on the time grid: missing steps, islands, chunks, completeness and what a backfill has to fetch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import BACKFILL_DAYS
from ..functions.scalar import at
from .bars import STEP, grid
from .scope import scope, series, with_total

SECONDS = {"minute": 60, "hour": 3600, "day": 86_400}


def missing_steps(candles: DataFrame, start: str | Column, end: str | Column, unit: str = "minute") -> DataFrame:
    """symbol, start_time of the expected steps that have no candle."""
    keys = [*series(candles), "start_time"]
    return grid(candles, start, end, unit).join(candles.select(*keys), keys, "left_anti")


def islands(missing: DataFrame, unit: str = "minute") -> DataFrame:
    """symbol, range_start, range_end (exclusive), steps of each run of consecutive steps."""
    keys = series(missing)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy("start_time"))
    run = F.unix_timestamp(F.col("start_time").cast("timestamp")) - number * SECONDS[unit]
    return missing.withColumn("run", run).groupBy(*keys, "run").agg(
        F.min("start_time").alias("range_start"), (F.max("start_time") + F.expr(STEP[unit])).alias("range_end"), F.count(F.lit(1)).alias("steps")
    ).drop("run")


def chunks(ranges: DataFrame, steps: int, unit: str = "minute") -> DataFrame:
    """Ranges cut into pieces of at most ``steps`` steps: symbol, chunk_start, chunk_end."""
    size = F.make_dt_interval(secs=F.lit(steps * SECONDS[unit]).cast("decimal(18,6)"))
    starts = F.explode(F.sequence(F.col("range_start"), F.col("range_end") - F.expr(STEP[unit]), size))
    return ranges.select(*series(ranges), "range_end", starts.alias("chunk_start")).select(*series(ranges), "chunk_start", F.least(F.col("chunk_start") + size, F.col("range_end")).alias("chunk_end"))


def backfill_window(candles: DataFrame, now: str | Column, symbol: str, days: int = BACKFILL_DAYS) -> DataFrame:
    """start, end of what a gap scan of each market looks at: from the earlier of now - 30 min and the minute after the latest
    candle of ``symbol``, its primary one, but no more than ``days`` back. A market without such a candle has 30 minutes."""
    keys = scope(candles)
    last = candles.groupBy(*keys).agg(F.max(F.when(F.col("symbol") == symbol, F.col("start_time"))).alias("latest"))
    end = F.date_trunc("minute", at(now)).cast("timestamp_ntz")
    start = F.least(end - F.expr("INTERVAL 30 MINUTES"), F.coalesce(F.col("latest") + F.expr("INTERVAL 1 MINUTE"), end))
    return last.select(*keys, F.greatest(start, end - F.make_dt_interval(F.lit(days))).alias("start"), end.alias("end"))


def backfill_chunks(candles: DataFrame, windows: DataFrame, steps: int, unit: str = "minute") -> DataFrame:
    """symbol, chunk_start, chunk_end of what a backfill has to fetch: the missing steps of each market's own window."""
    keys, each = scope(candles), series(candles)
    every = candles.select(*each).distinct()
    every = every.join(windows, keys) if keys else every.crossJoin(F.broadcast(windows))
    expected = every.where("start < end").select(*each, F.explode(F.sequence(F.col("start"), F.col("end") - F.expr(STEP[unit]), F.expr(STEP[unit]))).alias("start_time"))
    missing = expected.join(candles.select(*each, "start_time"), [*each, "start_time"], "left_anti")
    return chunks(islands(missing, unit), steps, unit)


def completeness(candles: DataFrame, expected: int | None = None) -> DataFrame:
    """start_time, present, expected, complete: whether a step has all symbols of its market."""
    keys = [*scope(candles), "start_time"]
    each = candles.groupBy(*keys).agg(F.count_distinct("symbol").alias("present"))
    each = with_total(each, candles) if expected is None else each.withColumn("expected", F.lit(expected).cast("bigint"))
    return each.select(*keys, "present", "expected", (F.col("present") >= F.col("expected")).alias("complete"))


def publishable(candles: DataFrame, now: str | Column, expected: int | None = None, minutes: int = 2) -> DataFrame:
    """Candles of complete steps older than ``minutes``."""
    keys = [*scope(candles), "start_time"]
    done = completeness(candles, expected).where("complete").select(*keys)
    old = candles.where(F.col("start_time") < at(now) - F.make_dt_interval(mins=F.lit(minutes)))
    return old.join(done, keys, "left_semi")


def missing_symbols(candles: DataFrame, symbols: DataFrame, time: str | Column) -> DataFrame:
    """The names of ``symbols`` without a candle at ``time``."""
    keys = series(symbols)
    return symbols.select(*keys).distinct().join(candles.where(F.col("start_time") == at(time)).select(*keys), keys, "left_anti")


def payload_counts(candles: DataFrame, base: str | Column, offsets: list[int]) -> DataFrame:
    """hours (0 for the newest), present, expected symbols of a published event, for each market."""
    from .selectors import hours_back

    keys = scope(candles)
    found = hours_back(candles, base, [0, *offsets]).groupBy(*keys, "hours").agg(F.count_distinct("symbol").alias("present"))
    every = with_total(candles.select(*keys).distinct() if keys else candles.sparkSession.range(1), candles)
    every = every.select(*keys, "expected", F.explode(F.array(*[F.lit(h) for h in [0, *offsets]])).alias("hours"))
    return every.join(found, [*keys, "hours"], "left").select(*keys, "hours", F.coalesce("present", F.lit(0)).alias("present"), "expected")


def scan_window(candles: DataFrame, primary: str, start: str | Column, as_of: str | Column, unit: str = "minute") -> DataFrame:
    """end, ready for each market: up to where a scan of [start, as_of) may go, and whether it may run.

    A step in which no symbol has a candle stalls the window there; it goes on once the step is filled. A scan is ready if
    the window reaches ``as_of`` and the ``primary`` symbol has a positive price in its last step.
    """
    keys, step = scope(candles), F.expr(STEP[unit])
    kept = candles.where((F.col("start_time") >= at(start)) & (F.col("start_time") < at(as_of)))
    led = F.bool_or((F.col("symbol") == primary) & (F.col("start_time") == at(as_of) - step) & (F.coalesce("close", F.lit(0)) > 0))
    have = kept.groupBy(*keys).agg(F.collect_set("start_time").alias("have"), led.alias("led"))
    gap = F.array_min(F.array_except(F.sequence(at(start), at(as_of) - step, step), "have"))
    return have.select(*keys, F.coalesce(gap, at(as_of)).alias("end"), (gap.isNull() & F.col("led")).alias("ready"))
