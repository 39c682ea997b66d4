"""Structured Streaming: minute candles, deduplication, rolling z-scores in keyed state, correlation snapshots.

Each starts from a folder of landed Parquet files and runs until what has landed is used up (``availableNow``), or on a
trigger of one's own. State and progress live in the checkpoint below ``work``, a folder that all executors share.

With a watermark, rows later than it are lost and state expires: that is for live ticks. A replay of a table that has
landed in any order of time takes no watermark; its state, in RocksDB, is kept to the end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from ..config import COINTEGRATION_CADENCE_MINUTES
from ..functions.scalar import at, hours
from ..operators import correlation
from ..operators.bars import unpivot
from ..operators.scope import scope, series
from ..operators.zscore import LEAST_VARIANCE
from ..sources import vendors
from ..sources.commits import Snapshot, Tables, save_matrices, save_scan

#: Windows that are worked out at once.
FRAMES = 1024
TICKS = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def ticks(spark: SparkSession, path: str, lateness: str | None = "10 minutes", files_per_trigger: int = 64) -> DataFrame:
    """Landed ticks as a stream with a watermark, or without one if ``lateness`` is None; ``ts`` with a zone, as watermarks need."""
    rows = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", lateness) if lateness else rows


@contextmanager
def _rocksdb(spark: SparkSession) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(spark: SparkSession, writer, work: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts the query; without a trigger it runs until what has landed is used up, else it goes on in the background."""
    with _rocksdb(spark):
        query = writer.option("checkpointLocation", f"{work}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
    if trigger is None or "processingTime" not in trigger:
        query.awaitTermination()
    return query


def minute_bars(rows: DataFrame, unit: str = "1 minute") -> DataFrame:
    """Streaming candles; a candle is updated until the watermark has passed its end, without one at any time."""
    order = F.struct("ts", "event_id")
    bars = rows.groupBy(*scope(rows), F.col("event_type").alias("symbol"), F.window("ts", unit).alias("w")).agg(
        F.min_by("value", order).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", order).alias("close"),
        F.sum("value").alias("base_volume"), F.count(F.lit(1)).alias("number_of_trades"),
    )
    return bars.select(*series(bars), F.col("w.start").cast("timestamp_ntz").alias("start_time"), "open", "high", "low", "close", "base_volume", "number_of_trades")


def land_minute_bars(rows: DataFrame, work: str, unit: str = "1 minute", trigger: dict | None = None) -> DataFrame:
    """Runs the candles to the end of what has landed and returns each candle's last update.

    Updates are written by batch number, so a batch that is run again after a failure replaces its own rows.
    """
    spark, out = rows.sparkSession, f"{work}/bars"
    bars = minute_bars(rows, unit)
    spark.createDataFrame([], bars.schema).write.mode("ignore").parquet(f"{out}/batch=-1")
    _run(spark, bars.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")), work, trigger)
    found = spark.read.schema(StructType([*bars.schema.fields, StructField("batch", LongType())])).parquet(out)
    keys = [*series(bars), "start_time"]
    rest = [c for c in bars.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def deduplicated(rows: DataFrame, keys: list[str], expire: bool = True) -> DataFrame:
    """Each key once within the watermark; later repeats and late rows are dropped. Without ``expire``, once ever."""
    return rows.dropDuplicatesWithinWatermark(keys) if expire else rows.dropDuplicates(keys)


@dataclass(frozen=True)
class Stepped:
    """A stream whose batches are worked on as tables, by joins, groups and sorts of Spark's own; no task holds a key's rows.

    ``step`` makes of a batch and of the rows that are held, of ``schema``, what is sent and what is held from then on:
    rows of ``schema`` and ``held``. ``columns`` are those of ``schema`` that are sent, by default all.
    """

    rows: DataFrame
    step: Callable[[DataFrame, DataFrame], DataFrame]
    schema: StructType
    columns: list[str] | None = None


def _land_stepped(rows: Stepped, work: str, trigger: dict | None) -> DataFrame:
    """Each batch writes what it sends and holds by its number and starts from what the one before holds; run again, it replaces its rows."""
    spark, out = rows.rows.sparkSession, f"{work}/rows"
    schema = StructType([*rows.schema.fields, StructField("held", BooleanType())])
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{out}/batch=-1")

    def batch(b: DataFrame, i: int) -> None:
        held = b.sparkSession.read.schema(schema).parquet(f"{out}/batch={i - 1}").where("held").drop("held")
        rows.step(b, held).write.mode("overwrite").parquet(f"{out}/batch={i}")

    _run(spark, rows.rows.writeStream.foreachBatch(batch), work, trigger)
    return spark.read.schema(schema).parquet(out).where("not held").select(*(rows.columns or rows.schema.names))


def land(rows: DataFrame | Stepped, work: str, trigger: dict | None = None) -> DataFrame:
    if isinstance(rows, Stepped):
        return _land_stepped(rows, work, trigger)
    out = f"{work}/rows"
    _run(rows.sparkSession, rows.writeStream.format("parquet").option("path", out), work, trigger)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def land_updates(rows: DataFrame, work: str, trigger: dict | None = None) -> DataFrame:
    """All updates of a query in update mode, by batch number."""
    out = f"{work}/updates"
    rows.sparkSession.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{out}/batch=-1")
    _run(rows.sparkSession, rows.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}")), work, trigger)
    return rows.sparkSession.read.schema(rows.schema).parquet(out)


def complete_or_forced(rows: DataFrame, expected: int, expire: bool = True) -> DataFrame:
    """start_time, symbols, complete: a minute is sent at once when all its symbols are there, or when a newer one begins.

    The state of a minute is the set of its symbols; once the watermark has passed it, an incomplete minute is sent as it
    is. A complete minute is sent again when a batch brings it more symbols, so its greatest count is the last. Without
    ``expire``, for rows without a watermark, minutes wait for their symbols to the end and none is forced.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = set(state.get[0].split("\x1f")) if state.exists else set()
        if state.hasTimedOut:
            state.remove()
            if len(seen) < expected:
                yield pd.DataFrame([(*key, len(seen), False)], columns=names)
            return
        had = len(seen)
        for f in frames:
            seen |= set(f["symbol"])
        state.update(("\x1f".join(sorted(seen)),))
        if expire:
            state.setTimeoutTimestamp(int(key[-1].timestamp() * 1000) + 60_000)
        if len(seen) >= expected and len(seen) > had:
            yield pd.DataFrame([(*key, len(seen), True)], columns=names)

    keys = [*scope(rows), "start_time"]
    names = [*keys, "symbols", "complete"]
    each = rows.select("ts", *scope(rows), F.date_trunc("minute", "ts").alias("start_time"), F.col("event_type").alias("symbol"))
    return each.groupBy(*keys).applyInPandasWithState(step, ", ".join([*[f"{c} string" for c in scope(rows)], "start_time timestamp, symbols bigint, complete boolean"]), "symbols string", "update", GroupStateTimeout.EventTimeTimeout if expire else GroupStateTimeout.NoTimeout)


def rolling_zscore(bars: DataFrame, window: int) -> DataFrame:
    """symbol, ms, n, z, source over each symbol's last ``window`` candles, from a stream of candles.

    The state of a symbol is its last ``window`` values and the last time; a candle that isn't later is dropped. With a
    column ``source``, candles marked ``backfill`` bring the state up to date like any other (a stream that begins with a
    symbol's history starts from it), and one marked ``removed`` ends the symbol's state: what follows starts anew.
    """

    def scores(held: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n and z of each new value, which stands last in its window."""
        line = np.concatenate([np.full(window, np.nan), held, new])
        frames = np.lib.stride_tricks.sliding_window_view(line, window)[len(line) - window + 1 - len(new) :]
        n, z = np.zeros(len(new), np.int64), np.zeros(len(new))
        for at in range(0, len(new), FRAMES):
            part = frames[at : at + FRAMES]
            # From the window's last value on, so that large values keep their digits.
            away = part - part[:, -1:]
            n[at : at + FRAMES] = np.isfinite(away).sum(1)
            mean, var = np.nanmean(away, 1), np.nanvar(away, 1)
            ok = (n[at : at + FRAMES] >= 2) & (var > LEAST_VARIANCE)
            z[at : at + FRAMES] = np.where(ok, -mean / np.sqrt(np.where(ok, var, 1.0)), 0.0)
        return n, z

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = (np.frombuffer(state.get[0]), state.get[1]) if state.exists else (np.zeros(0), -1)
        group = pd.concat(list(frames)).sort_values("ms", kind="stable")
        ends = np.flatnonzero((group["source"] == "removed").to_numpy())
        for k, (a, b) in enumerate(zip([0, *(ends + 1)], [*ends, len(group)])):
            if k:
                held, last = np.zeros(0), -1
            part = group.iloc[a:b]
            part = part[np.isfinite(part["close"].astype(float)) & (part["ms"] > last)].drop_duplicates("ms")
            if not len(part):
                continue
            new = part["close"].to_numpy(float)
            n, z = scores(held, new)
            held, last = np.concatenate([held, new])[-window:], int(part["ms"].iloc[-1])
            yield pd.DataFrame({**dict(zip(keys, key)), "ms": part["ms"].to_numpy(), "n": n, "z": z, "source": part["source"].to_numpy()})
        if len(held):
            state.update((held.tobytes(), last))
        elif state.exists:
            state.remove()

    source = F.coalesce(F.col("source"), F.lit("live")) if "source" in bars.columns else F.lit("live")
    keys = series(bars)
    rows = bars.select(*keys, F.unix_millis(F.col("start_time").cast("timestamp")).alias("ms"), "close", source.alias("source"))
    return rows.groupBy(*keys).applyInPandasWithState(step, ", ".join([*[f"{c} string" for c in keys], "ms bigint, n bigint, z double, source string"]), "held binary, last bigint", "append", GroupStateTimeout.NoTimeout)


def last_updates(raw: DataFrame, order: str = "arrival") -> Stepped:
    """The last update of each symbol and minute of the vendor that sends candles anew until the minute changes, for ``land``.

    What is held is each symbol's open minute with its last update; the first update of a later minute closes it. Updates of
    a minute once a later one has begun are late and dropped. ``order`` is of any type that has an order; it is that of
    arrival, whatever the order of files and rows within a batch. Files are to land in the order of arrival.
    """
    parsed = vendors.hyperliquid_updates(raw, order)
    keys, kind = ["symbol", "start_time"], parsed.schema[order].dataType
    own = [c for c in parsed.columns if c != order]
    rest = [c for c in own if c not in keys]

    def step(new: DataFrame, held: DataFrame) -> DataFrame:
        # What is held came before all that is new.
        came = lambda n, x: F.struct(F.lit(n).alias("new"), x.alias("at")).alias("__came")
        both = held.select(*own, came(0, F.lit(None).cast(kind))).unionByName(new.select(*own, came(1, F.col(order))))
        later = Window.partitionBy("symbol").orderBy(F.desc("start_time")).rowsBetween(Window.unboundedPreceding, -1)
        # A row for each minute: when the first later one began, null for the open minute.
        ends = both.groupBy(*keys).agg(F.min("__came").alias("begun")).select(*keys, F.min("begun").over(later).alias("ended"))
        timely = both.join(ends, keys).where("ended is null or __came <= ended")
        last = timely.groupBy(*keys, F.col("ended").isNull().alias("held")).agg(F.max_by(F.struct(*rest), "__came").alias("r"))
        return last.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in own], "held")

    return Stepped(parsed, step, StructType([parsed.schema[c] for c in own]))


def _held(bars: DataFrame, work: str, longest_hours: int, as_of: str | None, trigger: dict | None, then: Callable[[DataFrame, str, int], None]) -> StreamingQuery:
    """After each batch of candles: takes them in and calls ``then`` with those of the longest window, its end, and the batch.

    A window ends after the newest hour that has landed, or at ``as_of``. The state is a table of the longest window's
    candles, of which each batch commits a new version and removes all but the last two: a batch costs the window and what
    it brings, however long the stream has run. Of a candle that came twice the first counts; of two in one batch, the one
    with the least values.
    """
    spark, tables = bars.sparkSession, Tables(bars.sparkSession, f"{work}/held")
    keys = [*series(bars), "start_time"]
    rest = [c for c in bars.columns if c not in keys]

    def batch(b: DataFrame, i: int) -> None:
        def change(now: Snapshot) -> dict:
            before = tables.read("candles", now)
            both = b.select(*bars.columns, F.lit(1).alias("__later"))
            both = both if before is None else before.withColumn("__later", F.lit(0)).unionByName(both)
            first = both.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("__later", *rest)).alias("r"))
            kept = first.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in bars.columns])
            # One value for each batch.
            end = as_of or both.agg((F.max("start_time") + F.expr("INTERVAL 1 HOUR")).cast("string")).first()[0]
            kept = kept.where(F.col("start_time") >= at(end) - hours(longest_hours)) if end is not None else kept
            return {"candles": (tables.write(kept, "candles"), kept.schema)}

        tables.commit(change, "candles", i)
        tables.vacuum()
        held = tables.read("candles")
        newest = as_of or held.agg((F.max("start_time") + F.expr("INTERVAL 1 HOUR")).cast("string")).first()[0]
        if newest is not None:
            then(held, newest, i)

    return _run(spark, bars.writeStream.foreachBatch(batch), work, trigger)


def correlation_snapshots(bars: DataFrame, work: str, windows: list[int], as_of: str | None = None, trigger: dict | None = None) -> DataFrame:
    """After each batch of candles the matrices are written anew, all in one commit; returns the last ones.

    The state is the table of candles, not an N by N matrix in a task.
    """
    tables = Tables(bars.sparkSession, f"{work}/matrices")
    _held(bars, work, max(windows), as_of, trigger, lambda kept, end, i: save_matrices(tables, correlation.matrix(unpivot(kept), end, windows, ["measure"]), "correlation", i) and None)
    return tables.read("matrix")


def cadence(minutes: int = COINTEGRATION_CADENCE_MINUTES) -> dict:
    """A trigger for ``minutes``."""
    return {"processingTime": f"{minutes} minutes"}


def cointegration_scans(bars: DataFrame, work: str, window_hours: int, primary: str, as_of: str | None = None, trigger: dict | None = None) -> tuple[DataFrame | None, Tables]:
    """After each batch of hourly candles a scan, if the window is whole and ``primary`` has a price in its last hour.

    Scans go to a history by hours, a table of the latest for each pair and a table of events, in one commit for each batch;
    a batch that is run again commits nothing twice. Returns the latest table, None before the first scan, and the tables;
    with a ``cadence`` the query goes on in the background, and the tables have what it commits.
    """
    from ..operators.cointegration import scan
    from ..operators.gaps import scan_window

    tables, keys = Tables(bars.sparkSession, f"{work}/scans"), [*scope(bars), "symbol1", "symbol2", "window_minutes"]

    def then(kept: DataFrame, end: str, i: int) -> None:
        start = at(end) - hours(window_hours)
        ready = scan_window(kept, primary, start, end, "hour").where("ready")
        if ready.isEmpty():
            return
        kept = kept.join(ready.select(*scope(bars)), scope(bars), "left_semi") if scope(bars) else kept
        found = scan(kept, start, at(end)).withColumns({"window_minutes": F.lit(60 * window_hours), "calculated_at": at(end)})
        save_scan(tables, found, keys, stream="cointegration", batch=i)

    _held(bars, work, window_hours, as_of, trigger, then)
    return tables.read("latest"), tables
