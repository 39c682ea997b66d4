"""Market-cap ranks, their join with an exchange's symbols, top-k and the chart defaults."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import CHART_DEFAULTS, MARKET_CAP_TOP
from ..functions.scalar import coin_symbol
from .scope import scope


def ranks(listed: DataFrame, column: str = "coins", keys: list[str] | None = None) -> DataFrame:
    """coin, rank (from 1) of a list in order, one list for each of ``keys``; a repeated coin has its last rank."""
    each = listed.select(*(keys or []), F.posexplode(column).alias("pos", "coin"))
    return each.groupBy(*(keys or []), F.upper("coin").alias("coin")).agg((F.max("pos") + 1).cast("bigint").alias("rank"))


def ranked_symbols(rank: DataFrame, symbols: DataFrame, suffix: str = "USDT", top: int = MARKET_CAP_TOP) -> DataFrame:
    """symbol, rank of the exchange's symbols on the list, the first ``top`` by rank, ties by name."""
    named = rank.select(coin_symbol(F.col("coin"), suffix).alias("symbol"), "rank")
    return top_k(named.join(symbols.select("symbol").distinct(), "symbol", "left_semi"), ["rank", "symbol"], top)


def top_k(rows: DataFrame, order: list, k: int) -> DataFrame:
    """The first ``k`` rows; none for k <= 0. Each task keeps ``k`` rows at most."""
    return rows.orderBy(*order).limit(max(k, 0))


def defaults(ranked: DataFrame, base: str | Column) -> DataFrame:
    """use, symbols: the charts' default symbols by rank, for each market. Comparisons leave out ``base``, its primary symbol.

    As a column, ``base`` is made from the columns of the market.
    """
    keys, base = scope(ranked), F.lit(base) if isinstance(base, str) else base
    order = F.array_sort(F.collect_list(F.struct("rank", "symbol")))
    first = ranked.groupBy(*keys).agg(F.transform(order, lambda x: x["symbol"]).alias("s")).withColumn("base", base)
    others = F.filter("s", lambda x: x != F.col("base"))
    uses = [(use, F.slice(others if apart else F.col("s"), 1, n)) for use, n, apart in CHART_DEFAULTS]
    uses.append(("price_change_percentage", F.array("base")))
    return first.select(*keys, F.explode(F.array(*[F.struct(F.lit(u).alias("use"), v.alias("symbols")) for u, v in uses])).alias("d")).select(*keys, "d.*")
