"""Candles picked by time: latest, first at or after a time, exact, several hours back; and the star join around them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at, hours
from .scope import series

#: A dimension is broadcast up to so many rows, counted first; a larger one is shuffled.
BROADCAST_ROWS = 100_000


def dimension(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a count that stops at ``rows`` shows that it is small."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def _picked(rows: DataFrame, keys: list[str], pick) -> DataFrame:
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(pick(F.struct(*rest)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def latest(rows: DataFrame, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The last row of each key: an aggregate with a map-side part, no sort."""
    return _picked(rows, keys or series(rows), lambda r: F.max_by(r, F.struct(*(order or ["start_time"]))))


def first_at_or_after(rows: DataFrame, target: str | Column, keys: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """Forward as-of: the first row of each key at or after ``target``."""
    order = order or ["start_time"]
    return _picked(rows.where(F.col(order[0]) >= at(target)), keys or series(rows), lambda r: F.min_by(r, F.struct(*order)))


def exactly(rows: DataFrame, time: str | Column, symbols: list[str] | None = None) -> DataFrame:
    kept = rows.where(F.col("start_time") == at(time))
    return kept.where(F.col("symbol").isin(symbols)) if symbols else kept


def hours_back(candles: DataFrame, base: str | Column, offsets: list[int]) -> DataFrame:
    """hours and the candle exactly so many hours before ``base``; pushed down as a list of times."""
    times = F.explode(F.array(*[F.struct(F.lit(h).alias("hours"), (at(base) - hours(h)).alias("start_time")) for h in offsets]))
    asked = candles.sparkSession.range(1).select(times.alias("t")).select("t.*")
    return candles.where(F.col("start_time").isin([at(base) - hours(h) for h in offsets])).join(F.broadcast(asked), "start_time")


def lagged(gridded: DataFrame, column: str, steps: int, name: str) -> DataFrame:
    """The value ``steps`` grid steps earlier."""
    return gridded.withColumn(name, F.lag(column, steps).over(Window.partitionBy(*series(gridded)).orderBy("start_time")))


def star(fact: DataFrame, *dims: tuple[DataFrame, Column]) -> DataFrame:
    """Inner equi-joins with dimensions, each broadcast only behind a check of its size."""
    for dim, on in dims:
        fact = fact.join(dimension(dim), on)
    return fact


def in_request_order(rows: DataFrame, requested: list[str], column: str = "symbol") -> DataFrame:
    """place and the rows of the requested names, each name once, unknown ones dropped."""
    asked = rows.sparkSession.createDataFrame([(i, s) for i, s in enumerate(dict.fromkeys(requested))], f"place bigint, `{column}` string")
    return rows.join(F.broadcast(asked), column)


def symbols_of(symbols: DataFrame, suffix: str = "") -> DataFrame:
    """symbol_id, symbol, exchange, contract_type of the symbol dimension, their names ending in ``suffix``."""
    return symbols.select(F.col("symbol_id").alias(f"symbol{suffix}_id"), F.col("name").alias(f"symbol{suffix}"), *[F.col(c).alias(f"{c}{suffix}") for c in ("exchange", "contract_type")])


def with_symbol(rows: DataFrame, symbols: DataFrame) -> DataFrame:
    """History rows (symbol_id, ...) with their symbol's name, exchange and contract type."""
    return rows.join(dimension(symbols_of(symbols)), "symbol_id").select("symbol", "exchange", "contract_type", *[c for c in rows.columns if c != "symbol_id"])


def with_both_symbols(pairs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Pairs (symbol1_id, symbol2_id, ...) with both names and the market, which is the same on both sides."""
    one, two = dimension(symbols_of(symbols, "1")), dimension(symbols_of(symbols, "2"))
    both = pairs.join(one, "symbol1_id").join(two, "symbol2_id").where("exchange1 = exchange2 and contract_type1 = contract_type2")
    return both.select(F.col("exchange1").alias("exchange"), F.col("contract_type1").alias("contract_type"), "symbol1", "symbol2", *[c for c in pairs.columns if c not in ("symbol1_id", "symbol2_id")])
