"""Streaming queries, run over the landed table until it is used up; their SQL is the batch form."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators.bars import bars, unpivot
from ..sources import vendors
from ..sources.logs import append_log, read_log
from ..sources.tables import table, work
from ..streaming import queries as Q
from ..streaming import state as S
from ..streaming.ring import ring_scans
from .market import AS_OF, BARS, LONG, PEARSON, WINDOWS, _pairs, r, with_rounded
from .market import SQL as MARKET
from .records import SQL as RECORDS

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _ticks(spark, sf):
    # A pattern matches a folder and a single file alike; a stream takes no path of one file. Files may span all times: no watermark.
    return Q.ticks(spark, f"{sf}/event[s].parquet", None)


@query("stream_minute_bars", MARKET["bars_minutely"])
def stream_minute_bars(spark, sf):
    return with_rounded(Q.land_minute_bars(_ticks(spark, sf), work(spark, "bars")))


@query("stream_dedup", "SELECT event_type, date_trunc('day', ts) AS day, count(*) AS n, round(sum(value), 4) + 0e0 AS value FROM events GROUP BY 1, 2")
def stream_dedup(spark, sf):
    """Every tick is delivered twice; each is kept once."""
    twice = _ticks(spark, sf).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    kept = Q.land(Q.deduplicated(twice, ["event_id"], expire=False), work(spark, "dedup"))
    return kept.groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("value"), 4).alias("value"))


#: Where the replays below cut the month: what lies between two of these lands at once.
CUTS = ["2024-01-11 00:00:00", "2024-01-21 00:00:00"]


def _slices(rows: DataFrame, time: str) -> list[DataFrame]:
    """``rows`` in three ranges of time."""
    cuts = [F.lit(c).cast("timestamp_ntz") for c in CUTS]
    t = F.col(time)
    return [rows.where(t < cuts[0]), rows.where((t >= cuts[0]) & (t < cuts[1])), rows.where(t >= cuts[1])]


def _replay(spark: SparkSession, slices: list[DataFrame], run: Callable[[DataFrame, str], DataFrame], stream: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """Lands one slice after the other and runs the stream to its end after each: it goes on from its checkpoint and state."""
    landed, work_, out = work(spark, "landed"), work(spark, "replay"), None
    for part in slices:
        part.write.mode("append").parquet(landed)
        rows = stream(landed) if stream else spark.readStream.schema(part.schema).parquet(landed)
        out = run(rows, work_)
    return out


ZSCORE = f"""WITH {BARS}, m AS (SELECT symbol, start_time, close, count(*) OVER w AS n, avg(close) OVER w AS mean, var_pop(close) OVER w AS var FROM bars
  WINDOW w AS (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT symbol, start_time, n, {r('CASE WHEN n >= 2 AND var > 1e-9 THEN (close - mean) / sqrt(var) ELSE 0 END')} AS z FROM m"""


def _scores(out: DataFrame) -> DataFrame:
    return out.select("symbol", F.timestamp_millis("ms").cast("timestamp_ntz").alias("start_time"), "n", rounded(F.col("z")).alias("z"))


@query("stream_zscore", ZSCORE)
def stream_zscore(spark, sf):
    hours = _slices(bars(table(spark, sf, "events")), "start_time")
    return _scores(_replay(spark, hours, lambda rows, work_: Q.land(Q.rolling_zscore(rows, 24), work_)))


@query("stream_zscore_seeded", f"{ZSCORE} WHERE start_time >= TIMESTAMP '{CUTS[1]}'")
def stream_zscore_seeded(spark, sf):
    """State that starts from the history: backfilled candles bring it up to date and aren't results themselves."""
    *past, live = _slices(bars(table(spark, sf, "events")), "start_time")
    parts = [*[p.withColumn("source", F.lit("backfill")) for p in past], live.withColumn("source", F.lit("live"))]
    return _scores(vendors.live_only(_replay(spark, parts, lambda rows, work_: Q.land(Q.rolling_zscore(rows, 24), work_))))


@query("stream_corr", MARKET["corr_matrix"])
def stream_corr(spark, sf):
    hours = _slices(bars(table(spark, sf, "events")), "start_time")
    return with_rounded(_replay(spark, hours, lambda rows, work_: Q.correlation_snapshots(rows, work_, WINDOWS, AS_OF)))


@query("stream_coint_scans", f"""WITH s AS ({MARKET["coint_scan"]}) SELECT symbol1, symbol2, 43200 AS window_minutes, hedge_ratio, spread_z, adf_t, TIMESTAMP '{AS_OF}' AS calculated_at FROM s
  WHERE (SELECT ready FROM ({RECORDS["scan_readiness"]}))""")
def stream_coint_scans(spark, sf):
    """A scan after each slice, for the month up to AS_OF: only the last slice makes the window whole, if any does."""
    hours = _slices(bars(table(spark, sf, "events")), "start_time")
    found = []
    _replay(spark, hours, lambda rows, work_: found.append(Q.cointegration_scans(rows, work_, 720, "view", AS_OF)[0]))
    none = spark.createDataFrame([], "symbol1 string, symbol2 string, window_minutes int, hedge_ratio double, spread_z double, adf_t double, calculated_at timestamp_ntz")
    out = found[-1] if found[-1] is not None else none
    return with_rounded(out.select(*none.columns))


@query("stream_coint_rings", SQL["stream_coint_scans"])
def stream_coint_rings(spark, sf):
    """The same scans from rings of prices in state, a row for each symbol."""
    hours = _slices(bars(table(spark, sf, "events")), "start_time")
    found = []
    _replay(spark, hours, lambda rows, work_: found.append(ring_scans(rows, work_, 720, "view", AS_OF)[0]))
    none = spark.createDataFrame([], "symbol1 string, symbol2 string, window_minutes int, hedge_ratio double, spread_z double, adf_t double, calculated_at timestamp_ntz")
    out = found[-1] if found[-1] is not None else none
    return with_rounded(out.select(*none.columns))


@query("stream_last_update", """WITH u AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS start_time, value, ts, event_id FROM events)
SELECT symbol, start_time, last(value ORDER BY ts, event_id) AS close FROM u WHERE start_time < (SELECT max(start_time) FROM u v WHERE v.symbol = u.symbol) GROUP BY 1, 2""")
def stream_last_update(spark, sf):
    """Updates of a candle until its minute ends, as they arrive: each minute once the next one has begun."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    price = F.col("value").cast("decimal(18,8)").cast("string")
    data = F.struct(ms.alias("t"), F.col("event_type").alias("s"), *[price.alias(c) for c in "ohlc"], price.alias("v"), F.lit(1).alias("n"))
    arrival = F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_id").alias("arrival")
    raw = table(spark, sf, "events").select("ts", arrival, F.to_json(F.struct(F.lit("candle").alias("channel"), data.alias("data"))).alias("raw"))
    out = _replay(spark, _slices(raw, "ts"), lambda rows, work_: Q.land(Q.last_updates(rows), work_))
    return out.select("symbol", F.col("start_time").cast("timestamp_ntz").alias("start_time"), F.col("close").cast("double").alias("close"))


@query("stream_forced_minutes", """WITH m AS (SELECT date_trunc('minute', ts) AS start_time, count(DISTINCT event_type) AS symbols FROM events GROUP BY 1)
SELECT start_time, symbols FROM m WHERE symbols < 2 AND start_time + INTERVAL 1 MINUTE < (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def stream_forced_minutes(spark, sf):
    """Minutes that the watermark has passed and that still lack symbols, sent as they are."""
    run = lambda rows, work_: Q.land_updates(Q.complete_or_forced(rows, 2), work_)
    out = _replay(spark, _slices(table(spark, sf, "events"), "ts"), run, lambda path: Q.ticks(spark, path))
    return out.where("not complete").select(F.col("start_time").cast("timestamp_ntz").alias("start_time"), "symbols")


@query("stream_complete_minutes", "SELECT date_trunc('minute', ts) AS start_time, count(DISTINCT event_type) AS symbols, count(DISTINCT event_type) >= 2 AS complete FROM events GROUP BY 1 HAVING count(DISTINCT event_type) >= 2")
def stream_complete_minutes(spark, sf):
    """Minutes that have two symbols or more, sent when the second is there and again with each later one; the last counts."""
    out = Q.land_updates(Q.complete_or_forced(_ticks(spark, sf), 2, expire=False), work(spark, "complete"))
    last = out.where("complete").groupBy("start_time", "complete").agg(F.max("symbols").alias("symbols"))
    return last.select(F.col("start_time").cast("timestamp_ntz").alias("start_time"), "symbols", "complete")


def _clock(values: DataFrame, time: str) -> DataFrame:
    """A row for each measure that only moves the time on."""
    marks = values.select("measure").distinct()
    return marks.select(*[F.lit(time).cast("timestamp_ntz").alias(c) if c == "start_time" else F.col(c) if c == "measure" else F.lit(None).cast(values.schema[c].dataType).alias(c) for c in values.columns])


@query("stream_corr_state", MARKET["corr_matrix"])
def stream_corr_state(spark, sf):
    """Matrices kept up step by step: the first slice is the history that the state starts from, the others come as a stream."""
    history, *live = _slices(unpivot(bars(table(spark, sf, "events"))), "start_time")
    live = [*live[:-1], live[-1].union(_clock(live[-1], "2024-01-30 23:00:00"))]
    out = _replay(spark, live, lambda rows, work_: S.land_correlation(rows, work_, WINDOWS, ["measure"], 3600, history=history))
    return with_rounded(out.select("measure", F.col("steps").alias("hours"), "symbol1", "symbol2", "n", "correlation"))


@query("stream_forced_by_newer", """WITH m AS (SELECT date_trunc('minute', ts) AS start_time, count(DISTINCT event_type) AS symbols FROM events GROUP BY 1)
SELECT start_time, least(symbols, 2) AS symbols, symbols >= 2 AS complete FROM m WHERE symbols >= 2 OR start_time < (SELECT max(start_time) FROM m)""")
def stream_forced_by_newer(spark, sf):
    """Each minute once: when it has two symbols, or as it is when the next one begins."""
    out = _replay(spark, _slices(table(spark, sf, "events"), "ts"), lambda rows, work_: Q.land(S.forced_by_newer(rows, 2), work_), lambda path: Q.ticks(spark, path, None))
    return out.select(F.col("start_time").cast("timestamp_ntz").alias("start_time"), "symbols", "complete")


@query("stream_published_once", "SELECT epoch_ms(date_trunc('minute', ts)) AS timestamp_ms, count(DISTINCT event_type) >= 0 AS sent FROM events GROUP BY 1")
def stream_published_once(spark, sf):
    """Every tick would publish its minute; each minute is published once, remembered among the last 500."""
    ms = F.unix_millis(F.date_trunc("minute", "ts").cast("timestamp"))
    raw = table(spark, sf, "events").select("ts", ms.alias("timestamp_ms"), F.unix_micros(F.col("ts").cast("timestamp")).alias("arrival"))
    out = _replay(spark, _slices(raw, "ts"), lambda rows, work_: Q.land(S.published_once(rows), work_))
    return out.select("timestamp_ms", F.lit(True).alias("sent"))


@query("stream_catchup", f"""WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms FROM events), p AS (SELECT ms, event_id FROM e WHERE ts < TIMESTAMP '{CUTS[0]}' ORDER BY ms DESC, event_id DESC LIMIT 1)
SELECT e.event_id, e.ms, e.event_type, e.value FROM e, p WHERE e.ms > p.ms OR (e.ms = p.ms AND e.event_id > p.event_id)""")
def stream_catchup(spark, sf):
    """A log is followed from the position that a reader had taken after the first slice; the others land one by one."""
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    raw = table(spark, sf, "events").select("ts", "event_id", "event_type", "value", F.concat_ws("-", ms, "event_id").alias("id"))
    log, work_ = work(spark, "log"), work(spark, "catchup")
    before, *after = _slices(raw, "ts")
    append_log(before, log)
    position, out = S.latest_position(before), None
    for part in after:
        append_log(part, log)
        out = Q.land(read_log(spark, log, "event_id bigint, ms bigint, event_type string, value double", position), work_)
    return out
