"""The stored layout: days are pruned, and what is worked out by symbol has no exchange."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from candlewick.operators import bars as B
from candlewick.operators import history, selectors, zscore
from candlewick.sources import sinks
from candlewick.sources.layout import store, stored
from candlewick.sources.tables import table


@pytest.fixture(scope="module")
def hourly(spark, sf):
    events = table(spark, sf, "events")
    exchange = F.when(F.col("user_id") % 2 == 0, "binance").otherwise("okx")
    return B.bars(events.withColumns({"exchange": exchange, "contract_type": F.lit("perpetual")}))


@pytest.fixture(scope="module")
def name(spark, hourly, tmp_path_factory):
    name = f"candles_{uuid.uuid4().hex}"
    path = f"file://{tmp_path_factory.mktemp('layout')}/t"
    cut = F.lit("2024-01-15 12:00:00").cast("timestamp_ntz")
    # Two appends, the cut inside a day.
    store(hourly.where(F.col("start_time") < cut), name, path, buckets=4)
    store(hourly.where(F.col("start_time") >= cut), name, path, buckets=4)
    yield name
    spark.sql(f"DROP TABLE {name}")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


def test_ranges_read_their_days(spark, hourly, name):
    found = stored(spark, name, "2024-01-10 06:00:00", "2024-01-12 00:00:00")
    want = B.between(hourly, "2024-01-10 06:00:00", "2024-01-12 00:00:00")
    assert rows(found) == rows(want) and found.count() > 0
    assert "PartitionFilters: [isnotnull(day" in plan(found)
    folders = {tuple(f.split("/")[-4:-1]) for f in found.inputFiles()}
    assert folders and all("2024-01-10" <= day.split("=")[1] <= "2024-01-12" for *_, day in folders)
    market = found.where("exchange = 'okx'")
    assert {f.split("/")[-4] for f in market.inputFiles()} == {"exchange=okx"}


def test_work_by_symbol_has_no_exchange(spark, hourly, name):
    long = lambda df: B.measure(df, "price")
    for work in (
        lambda df: zscore.rolling(long(df), 24),
        lambda df: zscore.rolling(long(df), 500),
        lambda df: selectors.latest(df, None, ["start_time"]),
        lambda df: selectors.first_at_or_after(df, "2024-01-10 06:30:00"),
        lambda df: selectors.lagged(long(df), "value", 24, "before"),
    ):
        found = work(stored(spark, name))
        assert "Exchange" not in plan(found), plan(found)
        assert rows(found) == rows(work(hourly))


def test_pair_histories_read_the_hours_since(spark, tmp_path):
    pairs = [("a", "b"), ("c", "a"), ("b", "c")]
    made = spark.createDataFrame([(*p, h, float(h)) for p in pairs for h in range(48)], "symbol1 string, symbol2 string, h int, price double")
    made = made.withColumn("calculated_at", F.expr("timestamp_ntz'2024-01-01 00:30:00' + make_interval(0, 0, 0, 0, h)")).drop("h")
    path = f"file://{tmp_path}/history"
    sinks.append_by_hour(made, path)
    since = "2024-01-02 20:30:00"
    found = history.pair_history(spark.read.parquet(path), "a", ["b", "c"], "price", since)
    assert rows(found) == rows(history.pair_history(made, "a", ["b", "c"], "price", since)) and found.count() == 8
    assert "hour_part" in plan(found).split("PartitionFilters: [")[1].split("]")[0]
    # Files of the hours before are no Parquet any more; a read of one of them would end in an error.
    for old in (tmp_path / "history").glob("hour_part=*/part-*"):
        if old.parent.name < "hour_part=2024010220":
            old.write_bytes(b"not parquet")
            (old.parent / f".{old.name}.crc").unlink(missing_ok=True)
    schema = found.sparkSession.read.parquet(f"{path}/hour_part=2024010220").schema.add("hour_part", "long")
    assert history.pair_history(spark.read.schema(schema).parquet(path), "a", ["b", "c"], "price", since).count() == 8
    with pytest.raises(Exception):
        spark.read.schema(schema).parquet(path).agg(F.sum("price")).collect()
