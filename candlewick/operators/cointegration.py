"""Cointegration scan of all pairs: hedge ratio, spread, Dickey-Fuller t and half-life.

A symbol is one row with its log prices as an array. Symbols are cut into blocks; a row for each two blocks has their
symbols once, and the kernel takes their pairs with numpy, some at a time. Pairs are made within a market.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bars import filled, measure, on_grid
from .blocks import PAIRS, block_pairs, pairs_of
from .scope import scope, series

LEAST_POINTS = 10
TINY = 1e-12
OUT = ["hedge_ratio", "intercept", "spread_mean", "spread_std", "spread_z", "half_life", "adf_t"]
LN2 = float(np.log(2.0))


def log_prices(candles: DataFrame, start: str | Column, end: str | Column, unit: str = "hour") -> DataFrame:
    """symbol, p: log prices on the dense grid, filled forward and then back.

    Symbols without any price, or with one that isn't positive, are dropped.
    """
    prices = measure(candles, "price")
    bad = F.bool_or(F.col("value") <= 0)
    dense = filled(on_grid(prices, start, end, unit), ["value"])
    keys = series(candles)
    ok = dense.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("start_time", "value"))).alias("v"), bad.alias("bad"), F.count("value").alias("n"))
    return ok.where("not bad and n > 0").select(*keys, F.transform("v", lambda x: F.ln(x["value"])).alias("p"))


def _div(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.divide(a, b, out=np.zeros_like(a), where=b > TINY)


def statistics(x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """The seven statistics of each row of log prices x (symbol 1) and y (symbol 2)."""
    mx, my = x.mean(1), y.mean(1)
    xc, yc = x - mx[:, None], y - my[:, None]
    beta = _div((xc * yc).mean(1), (xc * xc).mean(1))
    e = yc - beta[:, None] * xc
    mean = e.mean(1)
    std = np.sqrt(((e - mean[:, None]) ** 2).mean(1))
    lag, diff = e[:, :-1], np.diff(e, axis=1)
    n = lag.shape[1]
    lc, dc = lag - lag.mean(1)[:, None], diff - diff.mean(1)[:, None]
    var = (lc * lc).mean(1)
    b = _div((lc * dc).mean(1), var)
    sse = ((dc - b[:, None] * lc) ** 2).sum(1)
    se = np.sqrt(np.maximum(_div(sse / max(n - 2, 1), var * n), 0))
    phi = 1 + b
    decays = (phi > 0) & (phi < 1)
    half = np.where(decays, -LN2 / np.log(np.where(decays, phi, 0.5)), np.nan)
    return dict(zip(OUT, (beta, my - beta * mx, mean, std, _div(e[:, -1] - mean, std), half, _div(b, se))))


def _scan(keys: list[str]):
    names = [*keys, "symbol1", "symbol2", *OUT]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                symbols, z, first, second = pairs_of(batch.column("parts")[k].values, batch.column("same")[k].as_py(), batch.column("lo")[k].as_py())
                if z.shape[1] < LEAST_POINTS:
                    continue
                for lo in range(0, len(first), PAIRS):
                    i, j = first[lo : lo + PAIRS], second[lo : lo + PAIRS]
                    got = statistics(z[i], z[j])
                    market = [pa.array([batch.column(c)[k].as_py()] * len(i), pa.string()) for c in keys]
                    yield pa.RecordBatch.from_arrays([*market, pa.array([symbols[x] for x in i]), pa.array([symbols[x] for x in j]), *(pa.array(got[c], from_pandas=True) for c in OUT)], names)

    return run


def scan_prices(prices: DataFrame, keys: list[str], blocks: int | None = None) -> DataFrame:
    """``scan`` of rows ``keys``, symbol, p (log prices, equally many in a market)."""
    schema = ", ".join([*[f"{c} string" for c in keys], "symbol1 string, symbol2 string", *[f"{c} double" for c in OUT]])
    return block_pairs(prices, keys, blocks).mapInArrow(_scan(keys), schema)


def scan(candles: DataFrame, start: str | Column, end: str | Column, unit: str = "hour", blocks: int | None = None) -> DataFrame:
    """symbol1, symbol2 and the statistics of each pair of a market; symbol 2 is regressed on symbol 1.

    No rows for fewer than ten points or two symbols; ``half_life`` is null where the spread doesn't decay.
    """
    return scan_prices(log_prices(candles, start, end, unit), scope(candles), blocks)


def live_table(latest: DataFrame, sort: str = "abs_z", direction: str | None = None, limit: int = 50, offset: int = 0, symbols: list[str] | None = None) -> DataFrame:
    """A page of the live table: pairs with both symbols asked for, sorted with nulls as the largest, ties by name.

    An unknown sort key sorts by the time of calculation, newest first; an unknown direction is the key's default.
    """
    from ..config import LIVE_SORTS

    rows = latest.where(F.col("symbol1").isin(symbols) & F.col("symbol2").isin(symbols)) if symbols else latest
    key = sort if sort in LIVE_SORTS else "updated"
    column = {"abs_z": F.abs("spread_z"), "half_life": F.col("half_life"), "adf_t": F.col("adf_t"), "updated": F.col("calculated_at")}[key]
    down = {"asc": False, "desc": True}.get((direction or "").lower(), LIVE_SORTS[key])
    order = [column.desc_nulls_first() if down else column.asc_nulls_last(), F.col("symbol1"), F.col("symbol2")]
    digits = {"spread_z": 3, "half_life": 2, "adf_t": 3, "hedge_ratio": 6, "intercept": 6, "spread_std": 6}
    page = rows.orderBy(*order).offset(offset).limit(limit)
    return page.select(*scope(latest), F.concat_ws("-", "symbol1", "symbol2").alias("pair"), *[(F.round(c, d) + F.lit(0.0)).alias(c) for c, d in digits.items()], "calculated_at")
