"""Scans from rings of prices in state equal scans of the candles after each slice of a replay."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from candlewick.operators.cointegration import scan
from candlewick.streaming.ring import aligned, ring_scans

SCHEMA = "exchange string, contract_type string, symbol string, start_time timestamp_ntz, close double"
LENGTH = 16


def _candles(spark, rows):
    """Rows (exchange, symbol, hour, close)."""
    made = spark.createDataFrame(rows, "exchange string, symbol string, h int, close double")
    time = F.expr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h)")
    return made.select("exchange", F.lit("perpetual").alias("contract_type"), "symbol", time.alias("start_time"), "close").coalesce(1)


def _rows(df):
    names = ["exchange", "symbol1", "symbol2", "hedge_ratio", "spread_mean", "spread_std", "spread_z", "half_life", "adf_t"]
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*names).collect())


def test_rings_equal_the_scan_of_candles_after_each_slice(spark, tmp_path):
    rnd = random.Random(5)
    path, work = f"file://{tmp_path}/landed", f"file://{tmp_path}/work"
    walk = lambda: rnd.uniform(1, 9)
    prices = {(e, s, h): walk() for e in ("x", "y") for s in "abcd" for h in range(40)}
    # b is silent at times, c from the start of the second slice to its end; d has a price that isn't positive, then leaves it behind.
    for k in list(prices):
        e, s, h = k
        if (s == "b" and h % 3 == 1) or (s == "c" and 18 <= h < 30):
            del prices[k]
    prices["x", "d", 15] = 0.0
    seen, cuts = [], [(0, 17), (17, 30), (30, 40)]
    for n, (lo, hi) in enumerate(cuts):
        part = [(*k, v) for k, v in sorted(prices.items()) if lo <= k[2] < hi]
        late = [(e, "b", h, 5.0) for e in "xy" for h in (10, 13)] if n == 1 else []
        # What came before counts, so a second version of a candle changes nothing.
        again = [(e, "a", hi - 3, 99.0) for e in "xy"] if n == 2 else []
        seen += [*part, *late]
        _candles(spark, [*part, *late]).write.mode("append").parquet(path)
        if again:
            ring_scans(spark.readStream.schema(SCHEMA).parquet(path), work, LENGTH, "a")
            _candles(spark, again).write.mode("append").parquet(path)
        latest, tables = ring_scans(spark.readStream.schema(SCHEMA).parquet(path), work, LENGTH, "a")
        start, end = (f"2024-01-{1 + h // 24:02d} {h % 24:02d}:00:00" for h in (hi - LENGTH, hi))
        want = scan(_candles(spark, seen), start, end)
        newest = latest.where(F.col("calculated_at") == F.lit(end).cast("timestamp_ntz"))
        assert _rows(newest) == _rows(want) and want.count() > 0
    assert ("x", "a", "d") not in {r[:3] for r in _rows(tables.read("history").where("calculated_at < timestamp_ntz'2024-01-01 20:00:00'"))}


def test_a_step_without_prices_stalls_the_scan_until_it_is_filled(spark, tmp_path):
    path, work = f"file://{tmp_path}/landed", f"file://{tmp_path}/work"
    run = lambda: ring_scans(spark.readStream.schema(SCHEMA).parquet(path), work, LENGTH, "a")[0]
    _candles(spark, [("x", s, h, 1.0 + (h * k) % 7) for k, s in ((2, "a"), (3, "b")) for h in range(LENGTH) if h != 5]).write.parquet(path)
    assert run() is None
    _candles(spark, [("x", "b", 5, 2.5)]).write.mode("append").parquet(path)
    assert run().count() == 1
    # Without the primary's last price there is no scan.
    _candles(spark, [("x", "b", LENGTH, 2.5)]).write.mode("append").parquet(path)
    assert run().agg(F.max("calculated_at").cast("string")).first()[0] == "2024-01-01 16:00:00"


def test_rings_are_brought_to_one_end(spark):
    rings = spark.createDataFrame([("a", 9, [1.0, 2.0, 3.0]), ("b", 8, [1.0, None, 3.0]), ("c", 2, [1.0, 2.0, 3.0]), ("d", 11, [1.0, 2.0, 3.0])], "symbol string, newest bigint, prices array<double>")
    found = {r.symbol: r.prices for r in aligned(rings, F.lit(10), 3).collect()}
    assert found == {"a": [1.0, 2.0, 3.0], "b": [None, 3.0, None], "c": [None] * 3, "d": [None, None, 1.0]}
