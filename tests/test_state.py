"""Stateful operators: rolling correlation against the batch matrix at every step, forced minutes, published times, positions."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_oracle import values

from candlewick.operators import correlation
from candlewick.streaming import queries as Q
from candlewick.streaming import state as S


class Held(dict):
    """A map state, or under one key a value state, in memory."""

    def exists(self):
        return bool(self)

    def get(self, key=0, default=None):
        return super().get(key, default)

    def update(self, row):
        self[0] = tuple(row)

    getValue, containsKey = get, dict.__contains__

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]

    def iterator(self):
        return iter(self.items())


class Handle:
    def getValueState(self, *_):
        return Held()

    def getMapState(self, *_):
        return Held()


def processor(windows, rebuild=10_000):
    p = S.RollingCorrelation(windows, ["lo", "hi"], rebuild)
    p.init(Handle())
    return p


def feed(p, rows, lo=0, hi=0):
    frame = pd.DataFrame(rows, columns=["symbol", "step", "value", "source"]).assign(own=0)
    return pd.concat(p.handleInputRows((lo, hi), iter([frame]), None))


def direct(history, newest, window):
    """n and correlation of each pair from {(symbol, step): value}."""
    out = {}
    names = sorted({s for s, _ in history})
    for a in range(len(names)):
        for b in range(a + 1, len(names)):
            both = [(history[names[a], t], history[names[b], t]) for t in range(newest - window + 1, newest + 1) if (names[a], t) in history and (names[b], t) in history]
            # From the first value on, as differences of like values are exact.
            x, y = (np.array([p[k] - both[0][k] for p in both]) for k in (0, 1))
            ok = len(both) > 1 and x.std() > 0 and y.std() > 0
            out[names[a], names[b]] = (len(both), np.mean((x - x.mean()) * (y - y.mean())) / (x.std() * y.std()) if ok else 0.0)
    return out


def check(found, history, newest, windows, close=1e-8):
    for w in windows:
        got = {(r.symbol1, r.symbol2): (r.n, r.correlation) for r in found[found["steps"] == w].itertuples()}
        want = direct(history, newest, w)
        assert got.keys() == want.keys()
        for k, (n, c) in want.items():
            assert got[k][0] == n and abs(got[k][1] - c) < close, (w, k)


@pytest.mark.parametrize(("mean", "spread", "rebuild"), [(0, 1, 10_000), (1e9, 1e-3, 10_000), (1e9, 1e-3, 7)])
def test_correlation_state_equals_the_window_at_every_step(mean, spread, rebuild):
    """Gaps, a constant symbol, a value again (the first counts), and values of older steps that a window still holds."""
    rng, history = np.random.default_rng(4), {}
    p, windows, newest = processor([3, 10, 24], rebuild), [3, 10, 24], -1
    for step in [*range(0, 40), *range(44, 60), *range(200, 215)]:
        rows = []
        for s in "abcd":
            if s == "d" or rng.random() < 0.8:
                v = mean if s == "d" else mean + spread * (rng.normal() + (step % 5 if s != "c" else 0))
                rows += [(s, step, v, "live"), (s, step, v + 1, "live")]
                history.setdefault((s, step), v)
        late = step - int(rng.integers(1, 8))
        if late >= 0 and ("c", late) not in history and late > newest - 24:
            history["c", late] = mean + spread * rng.normal()
            rows.append(("c", late, history["c", late], "live"))
        newest = step
        check(feed(p, rows), history, newest, windows, 1e-6 if mean else 1e-8)
    assert all(k[0] > newest - 24 for k in p.steps), "steps that have left the longest window are forgotten"


def test_cost_of_a_step_does_not_grow_with_the_window():
    """Map reads for one more step of a full window."""
    reads = []
    for window in (50, 500):
        p = processor([window])
        for t in range(window + 5):
            feed(p, [("a", t, float(t % 7), "live"), ("b", t, float(t % 5), "live")])
        count, of = [0], p.steps.getValue
        p.steps.getValue = lambda k, of=of, count=count: (count.__setitem__(0, count[0] + 1), of(k))[1]
        feed(p, [("a", window + 5, 1.0, "live")])
        reads.append(count[0])
    assert reads[0] == reads[1] <= 3


def test_symbols_come_and_go():
    p, history = processor([10]), {}
    rows = lambda names, steps: [(s, t, float(hash((s, t)) % 97), "live") for t in steps for s in names]
    first = rows("ab", range(10))
    history |= {(s, t): v for s, t, v, _ in first}
    check(feed(p, first), history, 9, [10])
    # A new symbol is filled in by its own history alone.
    added = [(s, t, v, "backfill") for s, t, v, _ in rows("c", range(10))]
    history |= {(s, t): v for s, t, v, _ in added}
    check(feed(p, added), history, 9, [10])
    gone = feed(p, [("a", 10, None, "removed"), ("b", 10, 5.0, "live")])
    history = {k: v for k, v in history.items() if k[0] != "a"} | {("b", 10): 5.0}
    check(gone, history, 10, [10])
    # One that comes back starts anew.
    history["a", 11] = 3.0
    check(feed(p, [("a", 11, 3.0, "live")]), history, 11, [10])
    p.rebuild = 1
    history["b", 12] = 4.0
    check(feed(p, [("b", 12, 4.0, "live")]), history, 12, [10])


def test_correlation_stream_over_blocks_starts_and_restarts(spark, tmp_path):
    """Three blocks, a history that overlaps what has landed meanwhile, and the batch matrix after every slice."""
    rng, schema = np.random.default_rng(6), "exchange string, symbol string, start_time timestamp_ntz, measure string, value double"
    hour = lambda h: (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime()
    rows = lambda hs: [(e, f"s{k}", hour(h), "price", float(rng.normal())) for e in ("x", "y") for h in hs for k in range(6) if rng.random() < 0.8]
    path, parts = f"file://{tmp_path}/rows", [rows(range(20)), rows(range(20, 26)), rows(range(26, 31))]
    # Rows of 20 to 25 land after the position was taken and before the history was read: they are in both.
    history = spark.createDataFrame(parts[0] + parts[1], schema)
    all_rows = list(parts[0])
    for part in parts[1:]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
        all_rows += part
        got = S.land_correlation(spark.readStream.schema(schema).parquet(path), f"file://{tmp_path}/work", [4, 24], ["measure"], 3600, symbols=150, history=history)
        newest = max(r[2] for r in all_rows) + pd.Timedelta(hours=1)
        want = correlation.matrix(spark.createDataFrame(all_rows, schema), str(newest), [4, 24], ["measure"], "hour")
        columns = [F.col(c) for c in ("exchange", "measure", "symbol1", "symbol2", "n")]
        got = got.select(*columns, F.col("steps").alias("hours"), F.round("correlation", 7).alias("c"))
        assert values(got.toPandas()) == values(want.select(*columns, "hours", F.round("correlation", 7).alias("c")).toPandas()) and got.count() == 2 * 2 * 15


def land(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def test_a_newer_minute_forces_the_open_one(spark, tmp_path):
    schema = "exchange string, event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    at = lambda m, s=0: (pd.Timestamp("2024-01-01") + pd.Timedelta(minutes=m, seconds=s)).to_pydatetime()
    path = f"file://{tmp_path}/ticks"
    stream = lambda: spark.readStream.schema(schema).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    for rows in ([(at(0), "a"), (at(0, 5), "b"), (at(0, 6), "c"), (at(1), "a")], [(at(1, 30), "a"), (at(2), "a"), (at(1, 50), "b")], [(at(2, 9), "b")]):
        land(spark, path, [(e, i, t, 1, s, 1.0, "{}") for e in ("x", "y") for i, (t, s) in enumerate(rows)], schema)
        out = Q.land(S.forced_by_newer(stream(), 2), f"file://{tmp_path}/work")
    got = sorted((r.exchange, r.start_time.minute, r.symbols, r.complete) for r in out.collect())
    # In the second batch b comes a minute late by its time, but in time order within its batch.
    assert got == [(e, *x) for e in ("x", "y") for x in ((0, 2, True), (1, 2, True), (2, 2, True))]
    land(spark, path, [("x", 9, at(3), 1, "a", 1.0, "{}"), ("x", 10, at(2, 59), 1, "c", 1.0, "{}")], schema)
    land(spark, path, [("x", 11, at(9), 1, "a", 1.0, "{}")], schema)
    out = Q.land(S.forced_by_newer(stream(), 2), f"file://{tmp_path}/work")
    assert {(r.start_time.minute, r.symbols, r.complete) for r in out.where("exchange = 'x' and minute(start_time) > 2").collect()} == {(3, 1, False)}


def test_the_501st_time_forgets_the_first(spark, tmp_path):
    path, schema = f"file://{tmp_path}/events", "timestamp_ms bigint, arrival bigint"
    for rows in ([(t, t) for t in range(500)] + [(0, 600), (499, 601)], [(0, 700), (500, 701), (1, 702), (0, 703), (None, 704)], [(500, 800), (3, 801)]):
        land(spark, path, rows, schema)
        out = Q.land(S.published_once(spark.readStream.schema(schema).parquet(path)), f"file://{tmp_path}/work")
    later = sorted(r.arrival for r in out.where("arrival >= 600").collect())
    # 500 forgets 0; 0 comes again and forgets 1; 3 is still known.
    assert later == [701, 703] and out.count() == 502


def test_a_log_goes_on_after_a_position(spark, tmp_path):
    path, schema = f"file://{tmp_path}/log", "id string, body string"
    ids = ["5-0", "5-1", "5-10", "5-9", "40-0", "39-7", "100"]
    land(spark, path, [(i, "x") for i in ids], schema)
    log = spark.read.schema(schema).parquet(path)
    assert S.latest_position(log) == "100-0" and S.latest_position(log.limit(0)) is None
    take = lambda p: {r.id for r in S.after_position(log, p).collect()}
    assert take(None) == set(ids) and take("5-9") == {"5-10", "40-0", "39-7", "100"} and take("40") == {"100"} and take("100-0") == set()
    start = S.latest_position(log.where("id != '100'"))
    out = Q.land(S.after_position(spark.readStream.schema(schema).parquet(path), start), f"file://{tmp_path}/work")
    land(spark, path, [("100-1", "y"), ("7-7", "late")], schema)
    out = Q.land(S.after_position(spark.readStream.schema(schema).parquet(path), start), f"file://{tmp_path}/work")
    assert sorted(r.id for r in out.collect()) == ["100", "100-1"]


def test_planted_drift_is_reported_and_none_otherwise():
    rng = np.random.default_rng(8)
    for planted in (False, True):
        p = processor([20], 10)
        for t in range(9):
            feed(p, [(s, t, float(rng.normal()), "live") for s in "abc"])
        if planted:
            names, own, ids, shift, sums, *rest = p.sums.get()
            wrong = np.frombuffer(sums).copy().reshape(1, 4, 3, 3)
            wrong[0, 3] += 50 * np.outer([1, 1, 0], [1, 1, 0])
            p.sums.update((names, own, ids, shift, wrong.tobytes(), *rest))
        found = [feed(p, [(s, t, float(rng.normal()), "live") for s in "abc"]) for t in (9, 10, 11)]
        worst = max(f["drift"].astype(float).max() for f in found if f["drift"].notna().any())
        assert (worst > S.DRIFT_TOLERANCE) == planted
        # Made anew, the sums are right again.
        assert feed(p, [("a", 12, 0.5, "live")])["correlation"].abs().max() <= 1


def test_the_listener_hears_of_each_check(spark, tmp_path):
    schema, path, listener = "symbol string, start_time timestamp_ntz, measure string, value double", f"file://{tmp_path}/rows", S.DriftListener()
    rng = np.random.default_rng(9)
    land(spark, path, [(s, (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=h)).to_pydatetime(), "price", float(rng.normal())) for h in range(30) for s in "abc"], schema)
    spark.streams.addListener(listener)
    try:
        S.land_correlation(spark.readStream.schema(schema).parquet(path), f"file://{tmp_path}/work", [4], ["measure"], 3600, rebuild=6)
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    finally:
        spark.streams.removeListener(listener)
    assert listener.checked and not listener.drifted


def test_forced_minutes_and_published_times_hold_no_batch(spark, tmp_path):
    """Shuffled ticks over several batches against loops over them; forced minutes have no Python task, published times no group of one."""
    schema, rng = "exchange string, ts timestamp, event_type string, timestamp_ms bigint, arrival bigint", np.random.default_rng(5)
    T = pd.Timestamp("2024-01-01", tz="UTC")
    open_, sent, held, once = {}, [], {}, []
    for b in range(4):
        n = 60
        rows = [(str(rng.choice(["x", "y"])), int(rng.integers(900 * b - 60, 900 * b + 900)), str(rng.choice(list("abc"))), int(rng.integers(0, 9)), 1000 * b + k) for k in range(n)]
        for e, sec, symbol, *_ in sorted(rows, key=lambda r: (r[1] // 60, r[1], r[2])):
            m, done, seen = open_.get(e, (-9, True, set()))
            if sec // 60 < m or (sec // 60 == m and done):
                continue
            if sec // 60 > m:
                if not done:
                    sent.append((e, m, len(seen), False))
                m, done, seen = sec // 60, False, set()
            seen = seen | {symbol}
            if len(seen) >= 2:
                sent.append((e, m, 2, True))
                done = True
            open_[e] = m, done, seen
        for e, *_, time, at in rows:
            if time not in held.setdefault(e, []):
                held[e] = [*held[e], time][-3:]
                once.append((e, time, at))
        land(spark, f"file://{tmp_path}/in", [(e, (T + pd.Timedelta(seconds=s)).to_pydatetime(), k, t, at) for e, s, k, t, at in (rows[i] for i in rng.permutation(n))], schema)
        stream = lambda: spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in")
        forced, published = S.forced_by_newer(stream(), 2), S.published_once(stream(), 3)
        minutes, times = Q.land(forced, f"file://{tmp_path}/forced"), Q.land(published, f"file://{tmp_path}/once")
    got = [(r.exchange, round((r.start_time - T.to_pydatetime().replace(tzinfo=None)).total_seconds() / 60), r.symbols, r.complete) for r in minutes.collect()]
    assert sorted(got) == sorted(sent) and {c for *_, c in sent} == {True, False}
    assert sorted(tuple(r) for r in times.collect()) == sorted(once) and len(once) > 100
    plan = lambda s: s.step(spark.createDataFrame([], s.rows.schema), spark.createDataFrame([], s.schema))._jdf.queryExecution().executedPlan().toString()
    assert "Pandas" not in plan(forced) and "Python" not in plan(forced)
    assert "MapInPandas" in plan(published) and "GroupsInPandas" not in plan(published)
