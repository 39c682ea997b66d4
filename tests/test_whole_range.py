"""Gap and season queries over whole tables: silent days, gaps over midnight, all years."""

from __future__ import annotations

import datetime as dt

import pandas as pd

from candlewick.plans import market, records

MONTH = 30 * 1440


def test_gaps_over_the_whole_range(spark, tmp_path):
    """``a`` ticks in the last minute but one before midnight and in the second after it, ``b`` in the first minute alone."""
    times = {"a": ["2024-01-10 23:58:30", "2024-01-11 00:01:00"], "b": ["2024-01-01 00:00:00"], "late": ["2024-02-01 00:00:00"]}
    rows = [(i, pd.Timestamp(t), 1, s, 1.0, "{}") for i, (s, t) in enumerate((s, t) for s, ts in times.items() for t in ts)]
    frame = pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    frame.astype({"ts": "datetime64[us]"}).to_parquet(tmp_path / "events.parquet", index=False)
    sf = str(tmp_path)
    missing = records.missing_minutes(spark, sf).groupBy("symbol").count().collect()
    assert {r.symbol: r["count"] for r in missing} == {"a": MONTH - 2, "b": MONTH - 1, "late": MONTH}
    islands = {(r.symbol, r.range_start, r.range_end, r.steps) for r in records.gap_islands(spark, sf).collect()}
    start, end, at = dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 31), dt.datetime(2024, 1, 10, 23, 59)
    minute = dt.timedelta(minutes=1)
    assert islands == {
        ("a", start, at - minute, 10 * 1440 - 2), ("a", at, at + 2 * minute, 2), ("a", at + 3 * minute, end, 20 * 1440 - 2),
        ("b", start + minute, end, MONTH - 1), ("late", start, end, MONTH),
    }
    chunks = records.gap_chunks(spark, sf).toPandas()
    assert (chunks["chunk_end"] - chunks["chunk_start"]).sum() / pd.Timedelta(minutes=1) == 3 * MONTH - 3
    assert (chunks["chunk_end"] - chunks["chunk_start"]).max() == pd.Timedelta(minutes=100)


def test_orders_of_all_years(spark, sf):
    got = market.seasonality_orders_dow(spark, sf).toPandas()
    orders = pd.read_parquet(f"{sf}/orders.parquet")
    assert orders["o_orderdate"].dt.year.nunique() > 1
    assert got["days"].sum() == len(orders.assign(day=orders["o_orderdate"].dt.floor("D"))[["o_orderpriority", "day"]].drop_duplicates())
