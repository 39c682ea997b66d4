"""The scan's window as state: each symbol keeps a ring of its last prices, and a scan reads the rings, not the candles.

A price goes to the place ``step mod length`` of its symbol's ring, over the one that stood there a whole length before;
steps that were passed over are emptied. So a candle costs what it writes and a batch the symbols that it brings, whatever
the length; of candles that came twice the first counts, and one older than the ring is dropped. A batch sends its symbols'
rings unrolled, oldest first. ``aligned`` brings rings to one end: a symbol that was silent since has empty steps there,
which are filled forward and then back, as a scan of the candles fills them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.scalar import at
from ..operators.cointegration import scan_prices
from ..operators.scope import scope, series
from ..sources.commits import Snapshot, Tables, save_scan
from .queries import _run


class PriceRing(StatefulProcessor):
    def __init__(self, keys: list[str], length: int):
        self.keys, self.length = keys, length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ring", "prices binary, newest bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            packed, newest = self.state.get()
            ring = np.frombuffer(packed).copy()
        else:
            ring, newest = np.full(self.length, np.nan), None
        given = pd.concat(list(rows)).sort_values(["step", "price"], kind="stable")
        for step, price in zip(given["step"].tolist(), given["price"].tolist()):
            if newest is None or step > newest:
                passed = self.length if newest is None else min(step - newest, self.length)
                ring[np.arange(step - passed + 1, step + 1) % self.length] = np.nan
                newest = step
            elif step <= newest - self.length:
                continue
            if np.isnan(ring[step % self.length]):
                ring[step % self.length] = np.nan if price is None else price
        self.state.update((ring.tobytes(), newest))
        unrolled = ring[np.arange(newest - self.length + 1, newest + 1) % self.length]
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "newest": [newest], "prices": [[None if np.isnan(x) else float(x) for x in unrolled]]})

    def close(self) -> None:
        pass


def price_rings(candles: DataFrame, length: int, seconds: int = 3600) -> DataFrame:
    """symbol (of each market), newest, prices of the symbols that a batch brings: a stream. Candles without a close don't count."""
    keys = series(candles)
    step = F.floor(F.unix_seconds(F.col("start_time").cast("timestamp")) / seconds).cast("bigint")
    each = candles.where("close is not null and symbol is not null").select(*keys, step.alias("step"), F.col("close").cast("double").alias("price"))
    out = ", ".join([*[f"{c} string" for c in keys], "newest bigint, prices array<double>"])
    return each.groupBy(*keys).transformWithStateInPandas(PriceRing(keys, length), out, "Update", "None")


def aligned(rings: DataFrame, end: Column, length: int) -> DataFrame:
    """``rings`` with ``prices`` of the ``length`` steps before the step ``end``; null where there is none."""
    ahead = F.greatest(F.least(end - 1 - F.col("newest"), F.lit(length)), F.lit(0)).cast("int")
    behind = F.greatest(F.col("newest") - end + 1, F.lit(0)).cast("int")
    none = lambda n: F.array_repeat(F.lit(None).cast("double"), n)
    kept = F.concat(none(behind), F.slice("prices", ahead + 1, F.greatest(F.lit(length) - ahead - behind, F.lit(0))), none(ahead))
    return rings.withColumn("prices", kept)


def log_rings(rings: DataFrame) -> DataFrame:
    """``rings`` with p, the logarithms of ``prices`` filled forward and then back; symbols as in ``cointegration.log_prices``."""

    def carried(p: Column) -> Column:
        start = F.struct(F.array().cast("array<double>").alias("out"), F.lit(None).cast("double").alias("last"))
        step = lambda acc, x: F.struct(F.array_append(acc["out"], F.coalesce(x, acc["last"])).alias("out"), F.coalesce(x, acc["last"]).alias("last"))
        return F.aggregate(p, start, step, lambda acc: acc["out"])

    ok = rings.where(F.exists("prices", lambda x: x.isNotNull()) & ~F.exists("prices", lambda x: F.coalesce(x <= 0, F.lit(False))))
    first = F.element_at(F.filter("prices", lambda x: x.isNotNull()), 1)
    return ok.select(*series(rings), F.transform(carried(F.col("prices")), lambda x: F.ln(F.coalesce(x, first))).alias("p"))


def ring_scans(candles: DataFrame, work: str, length: int, primary: str, as_of: str | None = None, seconds: int = 3600, trigger: dict | None = None) -> tuple[DataFrame | None, Tables]:
    """After each batch a scan of the last ``length`` steps, in markets whose window is whole and whose ``primary`` has its last price.

    A market's window ends after its newest step, or at ``as_of``; it is whole if each of its steps has a price of some
    symbol. What is kept between batches is a row for each symbol. Results are committed as ``cointegration_scans`` does.
    """
    spark, keys = candles.sparkSession, series(candles)
    market, held = scope(candles), Tables(spark, f"{work}/rings")
    tables, by = Tables(spark, f"{work}/scans"), [*scope(candles), "symbol1", "symbol2", "window_minutes"]
    rings = price_rings(candles, length, seconds)

    def batch(b: DataFrame, i: int) -> None:
        def change(now: Snapshot) -> dict:
            before = held.read("rings", now)
            both = b if before is None else before.join(b.select(*keys), keys, "left_anti").unionByName(b)
            return {"rings": (held.write(both, "rings"), b.schema)}

        held.commit(change, "rings", i)
        held.vacuum()
        now = held.read("rings")
        fixed = F.floor(F.unix_seconds(at(as_of).cast("timestamp")) / seconds).cast("bigint") if as_of is not None else None
        ends = now.groupBy(*market).agg((F.max("newest") + 1 if fixed is None else F.max(fixed)).alias("end"))
        each = now.join(ends, market) if market else now.crossJoin(F.broadcast(ends))
        each = aligned(each, F.col("end"), length)
        there = each.select(*market, "end", F.posexplode("prices").alias("k", "x"), (F.col("symbol") == primary).alias("led")).where("x is not null")
        whole = there.groupBy(*market, "end").agg(F.count_distinct("k").alias("steps"), F.bool_or((F.col("k") == length - 1) & F.col("led") & (F.col("x") > 0)).alias("led"))
        ready = whole.where((F.col("steps") == length) & F.col("led")).select(*market, "end")
        if ready.isEmpty():
            return
        each = each.join(ready.select(*market), market, "left_semi") if market else each
        found = scan_prices(log_rings(each), market)
        found = (found.join(ready, market) if market else found.crossJoin(F.broadcast(ready))).withColumn("calculated_at", F.timestamp_seconds(F.col("end") * seconds).cast("timestamp_ntz")).drop("end")
        save_scan(tables, found.withColumn("window_minutes", F.lit(length * seconds // 60)), by, stream="cointegration", batch=i)

    _run(spark, rings.writeStream.outputMode("update").foreachBatch(batch), work, trigger)
    return tables.read("latest"), tables
