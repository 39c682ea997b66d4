"""Golden values and properties of the operators."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.functions import scalar as S
from candlewick.operators import bars, cointegration, correlation, gaps, history, ranking, scope, seasonality, selectors, zscore
from candlewick.schema import KLINES, KLINES_KEY
from candlewick.sources import sinks, vendors

T0 = dt.datetime(2024, 1, 1)
A, B, C = [1, 2, None, 4, 5, 7], [2, 1, 5, None, 6, 8], [3] * 6
P1 = [100, 101, 103, 102, 104, 107, 106, 108, 110, 109, 111, 114]
G12 = [50, 50.6, 51.3, 51.2, 51.9, 52.9, 53.1, 53.9, 54.8, 54.6, 55.2, 56.2]
G13 = [50, 50.2, 51.5, 51.1, 51.8, 53.9, 52.7, 54.1, 54.9, 54.2, 55.9, 56.8]


def at(i: int) -> dt.datetime:
    return T0 + dt.timedelta(minutes=i)


def series(spark, **named):
    rows = [(s, at(i), None if v is None else float(v)) for s, vs in named.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "symbol string, start_time timestamp_ntz, value double")


def candles(spark, **named):
    return series(spark, **named).where("value is not null").withColumn("close", F.col("value")).withColumn("number_of_trades", F.lit(1)).withColumn("base_volume", F.lit(1.0)).withColumns({c: F.col("value") for c in ("open", "high", "low")}).drop("value")


def test_moments_and_pearson(spark):
    d = correlation.diagnostics(series(spark, a=A, b=B, c=C)).collect()
    by = {(r.symbol1, r.symbol2): r for r in d}
    ab = by["a", "b"]
    assert ab.n == 4 and ab.mean_x * 4 == 15 and ab.mean_y * 4 == 17
    assert ab.var_x * 4 + 15 * 15 / 4 == pytest.approx(79) and ab.covar * 4 + 15 * 17 / 4 == pytest.approx(90)
    assert ab.correlation == pytest.approx(0.9616852501)
    assert by["a", "c"].correlation == 0 and by["a", "c"].n == 5 and by["b", "c"].valid


def test_single_point_and_no_meeting(spark):
    got = correlation.matrix(series(spark, a=[1, None, None], b=[2, 3, None], c=[None, None, 4]), at(3), [1]).collect()
    assert len(got) == 3 and all(r.correlation == 0 for r in got)
    assert {(r.symbol1, r.symbol2): r.n for r in got} == {("a", "b"): 1, ("a", "c"): 0, ("b", "c"): 0}
    assert correlation.matrix(series(spark, a=[1]).limit(0), at(3), [1]).count() == 0


def test_rolling_by_running_sums_equals_frames(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = [None if rng.random() < 0.2 else float(v) for v in rng.normal(100, 2, 60)]
    y = [None if rng.random() < 0.2 else float(v) for v in rng.normal(50, 2, 60)]
    grid = series(spark, a=x, b=y, c=[7.0] * 60)
    key = lambda r: (r.symbol1, r.symbol2, r.start_time)
    frame = sorted(correlation.rolling(grid, 10).collect(), key=key)
    monkeypatch.setattr(correlation, "FRAME_STEPS", 1)
    run = sorted(correlation.rolling(grid, 10).collect(), key=key)
    assert len(frame) == 180
    for f, r in zip(frame, run):
        assert f.n == r.n and f.correlation == pytest.approx(r.correlation, abs=1e-9) and abs(r.correlation) <= 1 + 1e-9


def test_submatrix_requests(spark):
    long = correlation.matrix(series(spark, a=A, b=B, d=[6, 5, 4, 3, 2, 1]), at(6), [1])
    assert [tuple(r)[:3] for r in correlation.submatrix(long, ["d", "a", "x", "d"]).collect()] == [(0, "d", "a")]
    assert correlation.submatrix(long, ["nobody"]).count() == 3
    assert correlation.submatrix(long, ["a"]).count() == 0
    flat = correlation.triangle(long).first()
    assert flat.symbols == ["a", "b", "d"] and len(flat["values"]) == 3


def test_zscores(spark):
    long = series(spark, a=A, b=B, c=C, one=[5]).withColumn("measure", F.lit("price"))
    z = {r.symbol: r.z for r in zscore.snapshot(long, at(6), [1]).collect()}
    assert z["a"] == pytest.approx(1.4985372986) and z["b"] == pytest.approx(1.3970709463)
    assert z["c"] == 0 and z["one"] == 0
    exact = {r.start_time: r.z for r in zscore.rolling(series(spark, a=[1, 2, 3, 4, 6]), 4).collect()}
    assert exact[at(4)] == pytest.approx(1.5212776585)
    n, last = zscore.drifting([None, 1, 2, 3, 4, 6], 5)[-1]
    assert n == 5 and last == pytest.approx(1.6274669424)
    compat = zscore.rolling_compat(series(spark, a=[None, 1, 2, 3, 4, 6]), 5).orderBy("start_time").collect()
    assert compat[-1].n == 5 and compat[-1].z == pytest.approx(1.6274669424)


def test_fill_and_dropped_symbols(spark):
    rows = bars.filled(series(spark, a=[None, None, 1, None, 3, None]), ["value"]).orderBy("start_time").collect()
    assert [r.value for r in rows] == [1, 1, 1, 1, 3, 3]
    found = cointegration.log_prices(candles(spark, a=P1, zero=[0] + P1[1:], neg=[5] * 11 + [-1]), at(0), at(12), "minute")
    assert [r.symbol for r in found.collect()] == ["a"]


@pytest.mark.parametrize("p2, want", [(G12, (0.915713, -0.302659, 0.004076, -1.331, -3.083028)), (G13, (1.013978, -0.759015, 0.004418, -0.871685, -6.719475))])
def test_cointegration_golden(spark, p2, want):
    r = cointegration.scan(candles(spark, a=P1, b=p2), at(0), at(12), "minute").first()
    assert (r.hedge_ratio, r.intercept, r.spread_std, r.spread_z, r.adf_t) == pytest.approx(want, abs=2e-6)
    assert r.half_life is None


def test_cointegration_needs_points_and_pairs(spark):
    assert cointegration.scan(candles(spark, a=P1[:9], b=G12[:9]), at(0), at(9), "minute").count() == 0
    assert cointegration.scan(candles(spark, a=P1), at(0), at(12), "minute").count() == 0


def test_blocks_make_each_pair_once(spark):
    rows = spark.createDataFrame([(f"s{i:02d}", at(0), float(i)) for i in range(23)], "symbol string, start_time timestamp_ntz, value double")
    for blocks in (None, 1, 2, 5, 8):
        got = [(r.symbol1, r.symbol2) for r in correlation.all_pairs(rows, blocks=blocks).collect()]
        assert len(got) == len(set(got)) == 23 * 22 // 2 and all(a < b for a, b in got)
        found = correlation.matrix(rows, at(1), [1], blocks=blocks).collect()
        assert sorted((r.symbol1, r.symbol2) for r in found) == sorted(got) and all((r.n, r.correlation) == (1, 0.0) for r in found)


@pytest.mark.parametrize("blocks", [1, 4])
def test_kernels_over_blocks_equal_joins(spark, blocks):
    rng = np.random.default_rng(9)
    named = {f"s{k}": [None if rng.random() < 0.2 else float(v) for v in rng.normal(100 + k, 2, 40)] for k in range(9)} | {"same": [1e9 / 3] * 40}
    rows = series(spark, **named)
    got = {(r.hours, r.symbol1, r.symbol2): r.correlation for r in correlation.matrix(rows, at(40), [1], blocks=blocks).collect()}
    want = {(1, r.symbol1, r.symbol2): r.correlation for r in correlation.joined(rows, at(40), 1).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)
    assert correlation.drift(correlation.matrix(rows, at(40), [1]), rows, at(40), 1).where("drifted").count() == 0
    wrong = correlation.matrix(rows, at(40), [1]).withColumn("correlation", F.when((F.col("symbol1") == "s0") & (F.col("symbol2") == "s1"), 0.9).otherwise(F.col("correlation")))
    assert [(r.symbol1, r.symbol2) for r in correlation.drift(wrong, rows, at(40), 1).where("drifted").collect()] == [("s0", "s1")]
    one, many = (cointegration.scan(candles(spark, **named), at(0), at(40), "minute", k).collect() for k in (1, blocks))
    assert sorted(map(repr, one)) == sorted(map(repr, many)) and len(one) == 45


def test_markets_stand_alone(spark):
    """One symbol on two exchanges is two series, and pairs are made within an exchange."""
    a, b = candles(spark, x=A, y=B).withColumn("exchange", F.lit("one")), candles(spark, x=[9, 1, None, 5, 2, 8], z=B).withColumn("exchange", F.lit("two"))
    both = a.unionByName(b)
    alone = lambda f: {repr(r) for part in (a, b) for r in f(part).collect()}
    for f in (
        lambda d: bars.on_grid(d, at(0), at(6), "minute").select("exchange", "symbol", "start_time", "close"),
        lambda d: correlation.matrix(bars.measure(d, "price"), at(6), [1]),
        lambda d: zscore.snapshot(bars.unpivot(d), at(6), [1]),
        lambda d: gaps.missing_steps(d, at(0), at(6)),
        lambda d: gaps.completeness(d),
        lambda d: selectors.latest(d.select("exchange", "symbol", "start_time", "close")),
        lambda d: bars.synthetic(d, at(0), at(6), "minute").select("exchange", "symbol", "start_time", "close", "is_synthetic"),
        lambda d: gaps.scan_window(d, "x", at(0), at(6)),
    ):
        assert {repr(r) for r in f(both).collect()} == alone(f)
    assert scope.market(both, "two").count() == b.count() and set(selectors.latest(both).columns) == set(both.columns)


def test_scan_window_stalls_and_waits(spark):
    ready = lambda **c: [(r.end, r.ready) for r in gaps.scan_window(candles(spark, **c), "btc", at(0), at(4)).collect()]
    assert ready(btc=[1, 2, 3, 4], eth=[1, None, 2, None]) == [(at(4), True)]
    assert ready(btc=[1, None, 3, 4], eth=[1, None, 2, 4]) == [(at(1), False)]
    assert ready(btc=[1, 2, 3, None], eth=[1, 2, 3, 4]) == [(at(4), False)]


def test_default_charts(spark):
    ranked = spark.createDataFrame([(f"s{i:03d}", i) for i in range(1, 121)], "symbol string, rank int")
    got = {r.use: r.symbols for r in ranking.defaults(ranked, "s003").collect()}
    assert len(got["heatmap"]) == 50 and len(got["cointegration_live_table"]) == 75 and "s003" in got["heatmap"]
    assert got["correlation_pair_history"] == [f"s{i:03d}" for i in range(1, 12) if i != 3] and got["cointegration_pair_history"] == got["correlation_pair_history"][:5]
    assert got["price_change_percentage"] == ["s003"]


def test_first_page_counts(spark):
    rows = spark.createDataFrame([(2, "a", at(0), 5.0), (1, "a", at(0), 7.0), (2, "a", at(1), 1.0), (3, "a", at(9), 1.0)], "page int, symbol string, start_time timestamp_ntz, close double")
    got = vendors.pages(rows, at(0), at(5), "page").orderBy("start_time").collect()
    assert [(r.start_time, r.close) for r in got] == [(at(0), 7.0), (at(1), 1.0)] and "page" not in got[0].asDict()


def test_history_of_one_window(spark):
    rows = spark.createDataFrame([("a", "b", h, at(t), float(10 * h + t)) for h in (1, 4) for t in (0, 1)], "symbol1 string, symbol2 string, hours int, calculated_at timestamp_ntz, c double")
    value = lambda **k: [r.value for r in history.pair_history(rows, "b", ["a"], "c", at(0), 1, **k).collect()]
    assert value() == [10.0, 11.0] and value(window=4) == [40.0, 41.0]


def test_candles_of_two_exchanges_are_kept_apart(spark, tmp_path):
    raw = spark.createDataFrame([("x", '["1704067200000","1","2","0.5","1.5","10","20"]')], "symbol string, raw string")
    one, two = (vendors.klines(vendors.bybit_history(raw), e) for e in ("bybit", "okx"))
    where = f"file://{tmp_path}/klines"
    assert sinks.append_new(one.unionByName(one), where, KLINES_KEY, ["close"]).count() == 1
    assert sinks.append_new(one.unionByName(two), where, KLINES_KEY, ["close"]).count() == 1
    kept = spark.read.parquet(where)
    assert kept.count() == 2 and kept.columns == [c.split()[0] for c in KLINES.split(", ")] and not list(tmp_path.glob("*.stage-*"))


def test_retention_by_kind(spark, tmp_path):
    where = f"file://{tmp_path}/h"
    sinks.append_by_hour(spark.range(12).select(F.timestamp_seconds(1_704_067_200 + F.col("id") * 3600).cast("timestamp_ntz").alias("calculated_at")), where)
    gone = sinks.retain(spark, where, "correlation", T0 + dt.timedelta(hours=11, minutes=30))
    assert gone == [f"hour_part=20240101{h:02d}" for h in range(6)] and spark.read.parquet(where).count() == 6


def test_metrics_are_checked(spark):
    with pytest.raises(ValueError, match="spread_z"):
        history.coint_history(spark.range(0), "a", ["b"], "price; drop", at(0), 60)


def test_heatmap_leaves_out_symbols_without_records(spark):
    rows = spark.createDataFrame([("a", 1.0, 1, at(0)), ("a", 2.0, 1, at(1)), ("c", 3.0, 1, at(1))], "symbol string, price double, hours int, calculated_at timestamp_ntz")
    got = sorted((r.y, r.x, r.symbol, r.value) for r in zscore.heatmap(rows, "price", 1, ["c", "b", "a"]).collect())
    assert got == [(0, 0, "c", None), (0, 1, "c", 3.0), (1, 0, "a", 1.0), (1, 1, "a", 2.0)]


def test_heatmap_joins_times_that_read_alike_only_if_they_follow_each_other(spark):
    days = [("a", 1.0, 0), ("a", 2.0, 1440), ("c", 3.0, 1440), ("a", 4.0, 1441), ("a", 5.0, 2880)]
    rows = spark.createDataFrame([(s, v, 1, at(t)) for s, v, t in days], "symbol string, price double, hours int, calculated_at timestamp_ntz")
    got = sorted((r.symbol, r.x, r.value) for r in zscore.heatmap(rows, "price", 1, ["a", "c"]).collect())
    assert got == [("a", 0, 2.0), ("a", 1, 4.0), ("a", 2, 5.0), ("c", 0, 3.0), ("c", 1, None), ("c", 2, None)]


def test_backfill_of_each_market(spark):
    rows = [("x", "a", at(0)), ("x", "a", at(1)), ("y", "a", at(58)), ("z", "b", at(58)), ("y", "b", at(40))]
    have = spark.createDataFrame(rows, "exchange string, symbol string, start_time timestamp_ntz")
    windows = gaps.backfill_window(have, at(60), "a")
    assert {r.exchange: r.start for r in windows.collect()} == {"x": at(2), "y": at(30), "z": at(30)} and {r.end for r in windows.collect()} == {at(60)}
    got = sorted((r.exchange, r.symbol, r.chunk_start, r.chunk_end) for r in gaps.backfill_chunks(have, windows, 29).collect())
    assert got == [
        ("x", "a", at(2), at(31)), ("x", "a", at(31), at(60)), ("y", "a", at(30), at(58)), ("y", "a", at(59), at(60)),
        ("y", "b", at(30), at(40)), ("y", "b", at(41), at(60)), ("z", "b", at(30), at(58)), ("z", "b", at(59), at(60)),
    ]


def test_zscore_sinks(spark, tmp_path):
    scores = zscore.snapshot(bars.unpivot(candles(spark, x=A, y=B)), at(6), [1])
    where, snap = f"file://{tmp_path}/history", f"file://{tmp_path}/snap"
    for when, store in ((at(6), True), (at(6), True), (at(7), True), (at(8), False)):
        sinks.save_zscores(scores, when, where, snap, spark.createDataFrame([("x",)], "symbol string"), store)
    kept = spark.read.parquet(where).collect()
    assert sorted((r.symbol, r.hours, r.calculated_at) for r in kept) == [("x", 1, at(6)), ("x", 1, at(7))]
    assert sinks.read_snapshot(spark, snap).count() == 6
    sinks.save_heatmap(spark.read.parquet(where), "price", 1, ["x"], f"{snap}-heat")
    assert sinks.read_snapshot(spark, f"{snap}-heat/price-1").count() == 2


def test_hours_have_few_files_and_old_ones_are_not_read(spark, tmp_path):
    where = f"file://{tmp_path}/hours"
    rows = spark.range(0, 4000, 1, 40).select("id", (F.lit(at(0)) + F.make_dt_interval(mins=(F.col("id") % 360).cast("int"))).alias("calculated_at"))
    sinks.append_by_hour(rows, where)
    files = [str(f) for f in tmp_path.rglob("*.parquet")]
    assert spark.read.parquet(where).count() == 4000 and len({f.split("/")[-2] for f in files}) == 6 and len(files) <= 24
    kept = history.keep_partitions(spark.read.parquet(where).withColumn("hour_part", F.col("hour_part").cast("string")), at(300), 1)
    assert kept.count() == sum(i % 360 >= 180 for i in range(4000))


def test_live_table_order(spark):
    rows = spark.createDataFrame([("a", "b", 2.0), ("a", "c", None), ("b", "c", 1.0)], "symbol1 string, symbol2 string, half_life double")
    rows = rows.withColumns({c: F.lit(0.5) for c in ("spread_z", "adf_t", "hedge_ratio", "intercept", "spread_std")}).withColumn("calculated_at", F.lit(1))
    order = lambda **k: [r.half_life for r in cointegration.live_table(rows, "half_life", **k).collect()]
    assert order() == [1, 2, None] and order(direction="desc") == [None, 2, 1] and order(direction="sideways") == [1, 2, None]
    assert order(limit=1, offset=1) == [2] and order(symbols=["b", "c"]) == [1]
    assert cointegration.live_table(rows, "nonsense").count() == 3


@pytest.mark.parametrize("sort", ["half_life", "adf_t"])
def test_live_table_ties_are_of_what_is_shown(spark, duck, monkeypatch, sort):
    """Three pairs read 0.24 in another order than by name; the page begins and ends among them. Held against the query's own ORDER BY."""
    from candlewick.plans import market

    names = "symbol1 string, symbol2 string, " + ", ".join(f"{c} double" for c in cointegration.OUT)
    at_ = lambda k, x: (*k, 0.1, 0.2, 0.0, 0.3, x, x, x)
    found = [at_("ab", 0.24049), at_("ac", 0.24043), at_("ad", 0.24041), at_("bc", 0.24042), at_("bd", 0.2), at_("cd", 0.2401), at_("ce", 0.3), at_("de", None)]
    monkeypatch.setattr(cointegration, "scan", lambda *a: spark.createDataFrame(found, names))
    monkeypatch.setattr(market, "hourly", lambda *a: None)
    got = [tuple(r) for r in market.QUERIES[f"coint_live_table_{sort}"](spark, "").collect()]
    duck.execute(f"CREATE OR REPLACE TEMP TABLE pairs_found ({names.replace(' string', ' VARCHAR')})")
    duck.executemany(f"INSERT INTO pairs_found VALUES ({', '.join('?' * 9)})", found)
    sql = market.SQL[f"coint_live_table_{sort}"]
    assert got == duck.sql(f"SELECT symbol1 || '-' || {sql.split(' SELECT symbol1 || ' + chr(39) + '-' + chr(39) + ' || ', 1)[1].replace('FROM scan', 'FROM pairs_found')}").fetchall()


def test_seasonality_divides_by_close(spark):
    rows = spark.createDataFrame([("a", T0, 100.0, 110.0), ("a", T0 + dt.timedelta(days=1), 110.0, 99.0)], "symbol string, start_time timestamp_ntz, open double, close double")
    got = {r.period: r.value for r in seasonality.seasonality(rows, "day", "2024-01-03 00:00:00", 168, 4).collect()}
    assert got[1] == pytest.approx(9.0909) and got[2] == pytest.approx(-11.1111) and got[0] == 0 and len(got) == 7
    with pytest.raises(ValueError):
        seasonality.changes(rows, "week", "2024-01-03 00:00:00", 168)


def test_islands_and_chunks(spark):
    have = series(spark, a=[None if i in (0, 1, 2, 5, 6, 9) else 1 for i in range(10)]).where("value is not null")
    missing = gaps.missing_steps(have, at(0), at(10))
    ranges = gaps.islands(missing)
    minutes = lambda df, a, b: sorted(((r[a] - T0).seconds // 60, (r[b] - T0).seconds // 60) for r in df.collect())
    assert minutes(ranges, "range_start", "range_end") == [(0, 3), (5, 7), (9, 10)]
    assert minutes(gaps.chunks(ranges, 2), "chunk_start", "chunk_end") == [(0, 2), (2, 3), (5, 7), (9, 10)]
    assert {r.start_time for r in missing.collect()} == {at(i) for i in (0, 1, 2, 5, 6, 9)}
    window = gaps.backfill_window(have, at(60), "a").first()
    assert (window.start, window.end) == (at(9), at(60))
    assert [r.symbol for r in gaps.missing_symbols(have, spark.createDataFrame([("a",), ("b",)], "symbol string"), at(3)).collect()] == ["b"]


def test_first_and_last_writer(spark):
    schema = "k string, close int, v int"
    none, both = spark.createDataFrame([], schema), spark.createDataFrame([("K", 5, 1), ("K", 6, 2)], schema)
    assert history.insert_ignore(none, both, ["k"], ["v"]).first().close == 5
    assert history.insert_ignore(both, both, ["k"], ["v"]).count() == 0
    assert history.upsert_latest(both.where("v = 1"), both.where("v = 2"), ["k"], "v").first().close == 6


def test_selectors_and_ranks(spark):
    rows = series(spark, a=[1, 2, 3], b=[4])
    assert {r.symbol: r.value for r in selectors.latest(rows).collect()} == {"a": 3, "b": 4}
    assert [(r.symbol, r.value) for r in selectors.first_at_or_after(rows, at(1)).collect()] == [("a", 2)]
    assert [r.symbol for r in selectors.in_request_order(rows.where("value > 2"), ["b", "x", "a", "b"]).orderBy("place").collect()] == ["b", "a"]
    listed = spark.createDataFrame([(["btc", "eth", "BTC"],)], "coins array<string>")
    assert {r.coin: r["rank"] for r in ranking.ranks(listed).collect()} == {"BTC": 3, "ETH": 2}
    assert ranking.top_k(rows, ["value"], 0).count() == 0


def test_scalars(spark):
    one = spark.range(1)
    got = one.select(
        S.clean_params(F.lit(" a, b,,a ")).alias("params"), S.triangle_index(F.lit(3), F.lit(1), F.lit(4)).alias("flat"), S.triangle_index(F.lit(1), F.lit(1), F.lit(4)).alias("same"),
        S.ms_of(F.lit(1_700_000_000).cast("bigint")).alias("ms"), S.parse_day(F.lit("05 Jan 2024")).alias("day"), S.parse_day(F.lit("nonsense")).alias("no_day"),
        S.finite(F.lit(float("nan"))).alias("nan"), S.rounded(F.lit(-1e-9)).alias("zero"), S.stream_position(F.lit("12-3")).alias("pos"), S.safe_div(F.lit(1.0), F.lit(0.0), F.lit(False)).alias("div"),
    ).first()
    assert got.params == ["a", "b"] and got.flat == 4 and got.same is None and got.ms == 1_700_000_000_000
    assert got.day == dt.datetime(2024, 1, 5) and got.no_day is None and got.nan is None and str(got.zero) == "0.0" and tuple(got.pos) == (12, 3) and got.div == 0


LIVE = {
    "binance": ['{"e":"kline","k":{"t":60000,"T":119999,"s":"X","o":"1","h":"2","l":"0.5","c":"1.5","v":"3","n":4,"q":"5","V":"6","Q":"7","x":true}}', '{"e":"kline","k":{"t":60000,"T":119999,"s":"X","o":"1","h":"2","l":"1","c":"1","v":"3","n":4,"q":"5","V":"6","Q":"7","x":false}}', "junk"],
    "bybit": ['{"topic":"kline.1.X","data":[{"start":60000,"end":119999,"open":"1","high":"2","low":"0.5","close":"1.5","volume":"3","turnover":"5","confirm":true},{"start":120000,"end":179999,"open":"1","high":"2","low":"1","close":"1","volume":"3","turnover":"5","confirm":false}]}', "{}"],
    "okx": ['{"arg":{"channel":"candle1m","instId":"X"},"data":[["60000","1","2","0.5","1.5","3","4","5","1"],["120000","1","2","1","1","3","4","5","0"],["1"]]}', "[]"],
    "hyperliquid": ['{"channel":"candle","data":{"t":1700000040,"s":"X","o":"1","h":"2","l":"0.5","c":"1.2","v":"1","n":1}}', '{"channel":"candle","data":{"t":1700000040001,"s":"X","o":"1","h":"2","l":"0.5","c":"1.5","v":"3","n":4}}', '{"channel":"candle","data":{"t":1699999980000,"s":"X","o":"9","h":"9","l":"9","c":"9","v":"9","n":9}}', '{"channel":"other"}'],
}


@pytest.mark.parametrize("vendor", sorted(LIVE))
def test_live_candles(spark, vendor):
    raw = spark.createDataFrame(list(enumerate(LIVE[vendor])), "arrival int, raw string")
    if vendor == "hyperliquid":  # a minute of before is late and dropped
        raw = raw.where("arrival <> 2").union(spark.createDataFrame([(9, LIVE[vendor][2])], raw.schema))
    got = vendors.LIVE[vendor](raw).collect()
    assert len(got) == 1 and got[0].symbol == "X" and float(got[0].close) == 1.5 and float(got[0].base_volume) == 3
    minute = dt.datetime(2023, 11, 14, 22, 14) if vendor == "hyperliquid" else dt.datetime(1970, 1, 1, 0, 1)
    assert got[0].start_time == minute and got[0].close_time == minute + dt.timedelta(milliseconds=59_999)
    assert got[0].number_of_trades == (4 if vendor in ("binance", "hyperliquid") else 0)


def test_history_candles(spark):
    raw = {
        "binance": '[60000,"1","2","0.5","1.5","3",119999,"5",4,"6","7","0"]', "bybit": '["60000","1","2","0.5","1.5","3","5"]',
        "okx": '["60000","1","2","0.5","1.5","3","4","5","1"]', "hyperliquid": '{"t":1700000040000,"s":"X","o":"1","h":"2","l":"0.5","c":"1.5","v":"3","n":4}',
    }
    for vendor, text in raw.items():
        got = vendors.HISTORY[vendor](spark.createDataFrame([("X", text), ("X", "bad")], "symbol string, raw string")).collect()
        assert len(got) == 1 and float(got[0].close) == 1.5, vendor
    assert vendors.hyperliquid_history(spark.createDataFrame([("X", raw["hyperliquid"])], "symbol string, raw string"), 1_700_000_099_000).count() == 0


def test_symbols_prices_events(spark):
    raw = lambda *x: spark.createDataFrame([(t,) for t in x], "raw string")
    listed = raw('{"symbol":"AUSDT","contractType":"PERPETUAL","quoteAsset":"USDT","status":"TRADING"}', '{"symbol":"B","contractType":"CURRENT_QUARTER","quoteAsset":"USDT","status":"TRADING"}')
    assert [r.symbol for r in vendors.perpetual_symbols(listed, "binance").collect()] == ["AUSDT"]
    assert [tuple(r) for r in vendors.mid_prices(raw('{"A":"1.5","@1":"2","B":"x"}')).collect()] == [("A", 1.5)]
    assert vendors.market_caps(raw('[{"symbol":"btc"},{"symbol":"eth"}]')).first().coins == ["btc", "eth"]
    events = vendors.stream_events(raw('{"event_type":"kline","timestamp_ms":1,"newest":{},"oldest":{"4":{"A":{"price":1}}}}', '{"event_type":"kline"}')).collect()
    assert len(events) == 1 and events[0].oldest[4]["A"].price == 1


def test_sinks(spark, tmp_path):
    rows = series(spark, a=[1, 2, 3]).withColumn("calculated_at", F.col("start_time"))
    path = f"file://{tmp_path}/h"
    assert sinks.append_new(rows, path, ["symbol", "start_time"], ["value"]).count() == 3
    assert sinks.append_new(rows, path, ["symbol", "start_time"], ["value"]).count() == 0
    hist, last = f"file://{tmp_path}/hist", f"file://{tmp_path}/last"
    for v in (1, 2):
        sinks.save_history_and_latest(rows.limit(1).withColumn("value", F.lit(float(v))), hist, last, ["symbol"])
    assert spark.read.parquet(hist).count() == 2 and sinks.read_snapshot(spark, last).first().value == 2
    assert sinks.drop_old_hours(spark, hist, "2024010101") == ["hour_part=2024010100"]


def test_pair_history_rounds(spark):
    assert history.pair_history(spark.createDataFrame([("a", "b", at(0), 0.12345)], "symbol1 string, symbol2 string, calculated_at timestamp_ntz, spread_z double"), "b", ["a", "b", "c"], "spread_z", at(0)).collect()[0].value == 0.123


def test_pairs_in_one_order_and_equal_symbol_sets(spark):
    from candlewick.operators.history import canonical, same_symbols

    pairs = spark.createDataFrame([("b", "a", 1.0), ("a", "c", 2.0)], "symbol1 string, symbol2 string, z double")
    assert sorted(map(tuple, canonical(pairs).collect())) == [("a", "b", 1.0), ("a", "c", 2.0)]
    names = lambda *xs: spark.createDataFrame([(e, s) for e, s in xs], "exchange string, symbol string")
    one = names(("x", "a"), ("y", "b"))
    assert same_symbols(one, names(("y", "b"), ("x", "a"), ("x", "a"))) and not same_symbols(one, names(("x", "b"), ("y", "a"))) and not same_symbols(one, one.limit(1))


def test_appends_read_only_the_time_of_the_new_rows(spark, tmp_path):
    path, schema = f"file://{tmp_path}/history", "symbol string, calculated_at timestamp_ntz, z double"
    at = lambda h: dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    add = lambda *xs: sorted((r.symbol, r.z) for r in sinks.append_new(spark.createDataFrame([(s, None if h is None else at(h), z) for s, h, z in xs], schema), path, ["symbol", "calculated_at"], ["z"], "calculated_at").collect())
    assert add(("a", 0, 1.0), ("a", 5, 2.0), ("b", 5, 4.0), ("b", 5, 3.0)) == [("a", 1.0), ("a", 2.0), ("b", 3.0)]
    assert add(("a", 5, 9.0), ("a", 6, 9.0), ("c", 5, 9.0)) == [("a", 9.0), ("c", 9.0)]
    assert add(("a", 0, 8.0)) == [] and add(("d", None, 7.0)) == [("d", 7.0)] and add() == []
    assert spark.read.schema(schema).parquet(path).count() == 6


def test_a_drifted_zscore_is_flagged(spark):
    rows = [("s", dt.datetime(2024, 1, 1, h), float(v)) for h, v in enumerate([1, 5, 2, 9])]
    long = spark.createDataFrame(rows, "symbol string, start_time timestamp_ntz, value double")
    rolled = zscore.rolling(long, 4)
    found = [zscore.drift(x, long.withColumn("measure", F.lit("price")), "2024-01-01 04:00:00", 4).first() for x in (rolled, rolled.withColumn("z", F.col("z") + 0.3), rolled.withColumn("z", F.lit(51.0)))]
    assert [(r.drifted, r.valid) for r in found] == [(False, True), (True, True), (True, False)] and abs(found[0].z - found[0].independent) < 1e-12
