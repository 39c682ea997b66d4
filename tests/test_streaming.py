"""The streaming queries over more files than one batch takes, not in time order, against their SQL."""

from __future__ import annotations

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracle import values

from candlewick.operators import correlation
from candlewick.operators.bars import bars, unpivot
from candlewick.plans import streams
from candlewick.sources import vendors
from candlewick.streaming import queries as Q

FILES = 200


@pytest.fixture(scope="module")
def many(tmp_path_factory, sf) -> str:
    """The events dealt at random over more files than ``files_per_trigger``; each file spans all of the time.

    The month is pressed into 36 hours, so that minutes have several symbols.
    """
    folder = tmp_path_factory.mktemp("many") / "events.parquet"
    folder.mkdir()
    rows = pd.read_parquet(f"{sf}/events.parquet")
    start = pd.Timestamp("2024-01-01")
    rows["ts"] = (start + (rows["ts"] - start) / 20).astype("datetime64[us]")
    for i, part in enumerate(np.array_split(np.random.default_rng(7).permutation(len(rows)), FILES)):
        rows.iloc[part].to_parquet(folder / f"part-{i:03}.parquet", index=False)
    return str(folder.parent)


@pytest.mark.parametrize("name", ["stream_minute_bars", "stream_dedup", "stream_complete_minutes"])
def test_replay_over_several_batches_equals_sql(spark, duck, many, name):
    got = streams.QUERIES[name](spark, many).toPandas()
    duck.execute(f"CREATE OR REPLACE TEMP VIEW events AS SELECT * FROM read_parquet('{many}/events.parquet/*.parquet')")
    try:
        want = duck.sql(streams.SQL[name]).df()
    finally:
        duck.execute("DROP VIEW temp.events")
    assert len(want) and values(got) == values(want)


def landed(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_state_goes_on_after_a_restart_and_ends_with_its_symbol(spark, tmp_path):
    """Three runs from one checkpoint: history, live candles with one again and one late, then the symbol removed and new."""
    schema = "symbol string, start_time timestamp_ntz, close double, source string"
    path, hour = f"file://{tmp_path}/bars", lambda h: pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)
    runs = [
        [("a", hour(h), float(h), "backfill") for h in range(3)],
        [("a", hour(3), 10.0, "live"), ("a", hour(2), 99.0, "live"), ("b", hour(3), 1.0, None)],
        [("a", hour(4), None, "removed"), ("a", hour(5), 4.0, "live"), ("a", hour(6), 8.0, "live")],
    ]
    for rows in runs:
        landed(spark, path, [(s, t.to_pydatetime(), c, x) for s, t, c, x in rows], schema)
        out = Q.land(Q.rolling_zscore(spark.readStream.schema(schema).parquet(path), 3), f"file://{tmp_path}/work")
    got = {(r.symbol, r.ms // 3_600_000 % 24): (r.n, round(r.z, 6)) for r in vendors.live_only(out).collect()}
    z = lambda *v: round((v[-1] - np.mean(v)) / np.std(v), 6)
    assert got == {("a", 3): (3, z(1, 2, 10)), ("b", 3): (1, 0.0), ("a", 5): (1, 0.0), ("a", 6): (2, z(4, 8))}
    again = Q.land(Q.rolling_zscore(spark.readStream.schema(schema).parquet(path), 3), f"file://{tmp_path}/work")
    assert again.count() == out.count(), "nothing new has landed: nothing is sent again"


def test_snapshots_end_after_the_newest_hour(spark, sf, tmp_path):
    hours = bars(spark.read.parquet(f"{sf}/events.parquet"))
    path = f"file://{tmp_path}/hours"
    for part in streams._slices(hours, "start_time")[:2]:
        part.write.mode("append").parquet(path)
        got = Q.correlation_snapshots(spark.readStream.schema(hours.schema).parquet(path), f"file://{tmp_path}/work", [24, 72])
    held = spark.read.parquet(path)
    newest = str(held.agg({"start_time": "max"}).first()[0] + pd.Timedelta(hours=1))
    assert values(got.toPandas()) == values(correlation.matrix(unpivot(held), newest, [24, 72], ["measure"]).toPandas()) and got.count() > 0


def test_minutes_are_forced_once_and_only_if_incomplete(spark, tmp_path):
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = lambda m, s=0: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m, seconds=s)).to_pydatetime()
    path = f"file://{tmp_path}/ticks"
    for rows in ([(at(0), "a"), (at(0, 5), "b"), (at(1), "a")], [(at(30), "a"), (at(0, 9), "c")], [(at(60), "a")]):
        landed(spark, path, [(i, t, 1, s, 1.0, "{}") for i, (t, s) in enumerate(rows)], schema)
        out = Q.land_updates(Q.complete_or_forced(Q.ticks(spark, path), 2), f"file://{tmp_path}/work")
    got = sorted((r.start_time.minute, r.symbols, r.complete) for r in out.collect())
    assert got == [(0, 2, True), (0, 3, True), (1, 1, False), (30, 1, False)]


def test_last_updates_over_several_runs(spark, tmp_path):
    schema, path = "arrival bigint, raw string", f"file://{tmp_path}/raw"
    body = lambda m, c: json.dumps({"channel": "candle", "data": {"t": 1_704_067_200_000 + m * 60_000 + 5, "s": "x", "o": "1", "h": "2", "l": "1", "c": str(c), "v": "3", "n": 4}})
    for rows in ([(0, body(0, 1)), (1, body(0, 2))], [(2, body(0, 3)), (3, body(1, 4)), (4, body(0, 9)), (5, "no json")], [(6, body(3, 5))]):
        landed(spark, path, rows, schema)
        out = Q.land(Q.last_updates(spark.readStream.schema(schema).parquet(path)), f"file://{tmp_path}/work")
    assert sorted((r.start_time.minute, float(r.close), r.number_of_trades) for r in out.collect()) == [(0, 3.0, 4), (1, 4.0, 4)]


def test_last_updates_by_order_of_arrival_without_python_tasks(spark, tmp_path):
    """Shuffled batches with late updates and equal times of arrival, told apart by a number, against a loop; no step holds a symbol's rows in Python."""
    schema, path = "arrival struct<us:bigint,id:bigint>, raw string", f"file://{tmp_path}/raw"
    rng, batches, want, open_ = np.random.default_rng(8), [], {}, {}
    body = lambda s, m, c: json.dumps({"channel": "candle", "data": {"t": 1_704_067_200_000 + m * 60_000 + 5, "s": s, "o": "1", "h": "2", "l": "1", "c": str(c), "v": "3", "n": 4}})
    for b in range(4):
        # The last batch has nothing of y, which stays open.
        rows = [(1000 * b + k // 3, k, "x" if b == 3 else str(rng.choice(["x", "y"])), 9 * b + k // 12 - int(rng.integers(3)), 10_000 * b + k) for k in range(90)]
        for *_, s, m, c in rows:
            now, close = open_.get(s, (-9, None))
            if m > now and close is not None:
                want[s, now] = close
            open_[s] = (m, c) if m >= now else (now, close)
        batches.append([((us, i), body(s, m, c)) for us, i, s, m, c in rows])
    for rows in batches:
        landed(spark, path, [rows[k] for k in rng.permutation(len(rows))], schema)
        stream = Q.last_updates(spark.readStream.schema(schema).parquet(path))
        out = Q.land(stream, f"file://{tmp_path}/work")
    minute = lambda t: round((t - pd.Timestamp("2024-01-01").to_pydatetime()).total_seconds() / 60)
    assert {(r.symbol, minute(r.start_time)): int(r.close) for r in out.collect()} == want and out.count() == len(want) > 20
    held = spark.createDataFrame([], stream.schema)
    plan = stream.step(stream.rows.sparkSession.createDataFrame([], stream.rows.schema), held)._jdf.queryExecution().toString()
    assert "Pandas" not in plan and "Python" not in plan and "Arrow" not in plan


def test_streams_keep_markets_apart(spark, tmp_path):
    schema, path = "exchange string, symbol string, start_time timestamp_ntz, close double", f"file://{tmp_path}/bars"
    hour = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    landed(spark, path, [(e, "a", hour(h), float(v)) for e, vs in (("one", [1, 2, 3]), ("two", [5, 5, 9])) for h, v in enumerate(vs)], schema)
    rows = spark.readStream.schema(schema).parquet(path)
    out = Q.land(Q.rolling_zscore(rows, 3), f"file://{tmp_path}/work")
    z = lambda *v: round((v[-1] - np.mean(v)) / np.std(v), 6)
    assert {(r.exchange, r.n): round(r.z, 6) for r in out.where("n = 3").collect()} == {("one", 3): z(1, 2, 3), ("two", 3): z(5, 5, 9)}
    assert Q.minute_bars(rows.select("exchange", F.col("symbol").alias("event_type"), F.col("start_time").cast("timestamp").alias("ts"), F.col("close").alias("value"), F.lit(1).alias("event_id"))).columns[:2] == ["exchange", "symbol"]


def test_scans_wait_for_a_whole_window_and_keep_the_latest(spark, tmp_path):
    schema, path = "symbol string, start_time timestamp_ntz, open double, high double, low double, close double, base_volume double, number_of_trades bigint", f"file://{tmp_path}/bars"
    rng, hour = np.random.default_rng(2), lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    rows = lambda hs, names: [(s, hour(h), *[float(100 + rng.normal())] * 4, 1.0, 1) for h in hs for s in names]
    seen = []
    for part in (rows(range(11), "abc"), rows([11], "abc"), rows([12], "bc"), rows([14], "abc")):
        landed(spark, path, part, schema)
        latest, tables = Q.cointegration_scans(spark.readStream.schema(schema).parquet(path), f"file://{tmp_path}/work", 12, "a")
        seen.append(None if latest is None else sorted({str(r.calculated_at) for r in latest.collect()}))
    assert seen == [None, *[["2024-01-01 12:00:00"]] * 3], "too short; whole; without the primary symbol; with a missing hour"
    assert latest.count() == 3 and tables.read("history").count() == 3 and Q.cadence() == {"processingTime": "15 minutes"}


def test_scans_on_a_cadence_publish_one_event_each(spark, tmp_path):
    """A query on a short cadence in the background: two ticks with candles give two scans and two events."""
    schema, path = "symbol string, start_time timestamp_ntz, open double, high double, low double, close double, base_volume double, number_of_trades bigint", f"file://{tmp_path}/bars"
    rng, hour = np.random.default_rng(2), lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    rows = lambda hs: [(s, hour(h), *[float(100 + rng.normal())] * 4, 1.0, 1) for h in hs for s in "abc"]
    landed(spark, path, rows(range(12)), schema)
    _, tables = Q.cointegration_scans(spark.readStream.schema(schema).parquet(path), f"file://{tmp_path}/work", 12, "a", trigger={"processingTime": "1 second"})
    (query,) = [q for q in spark.streams.active]
    try:
        query.processAllAvailable()
        landed(spark, path, rows([12]), schema)
        query.processAllAvailable()
    finally:
        query.stop()
    events = sorted((str(r.calculated_at), r.n) for r in tables.read("events").collect())
    assert events == [("2024-01-01 12:00:00", 3), ("2024-01-01 13:00:00", 3)] and tables.read("history").count() == 6


def test_what_is_held_is_the_window_and_the_first_of_each_candle(spark, tmp_path):
    schema, path = "symbol string, start_time timestamp_ntz, close double", f"file://{tmp_path}/bars"
    hour, seen = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), []
    for rows in ([(h, 1.0) for h in range(5)], [(4, 9.0), (5, 3.0), (5, 2.0)], [(2, 8.0), (30, 4.0)], [(7, 1.0)]):
        landed(spark, path, [("a", hour(h), c) for h, c in rows], schema)
        Q._held(spark.readStream.schema(schema).parquet(path), f"file://{tmp_path}/work", 4, None, None, lambda held, end, i: seen.append((end[11:13], sorted((r.start_time.hour, r.close) for r in held.collect()))))
    assert seen == [("05", [(1, 1.0), (2, 1.0), (3, 1.0), (4, 1.0)]), ("06", [(2, 1.0), (3, 1.0), (4, 1.0), (5, 2.0)]), ("07", [(6, 4.0)]), ("07", [(6, 4.0)])]
