"""What a series is: a symbol, within an exchange and a contract type where the table has these columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCOPE = ("exchange", "contract_type")


def scope(df: DataFrame) -> list[str]:
    """The columns of ``df`` that set markets apart."""
    return [c for c in SCOPE if c in df.columns]


def series(df: DataFrame) -> list[str]:
    return [*scope(df), "symbol"]


def scoped(df: DataFrame, keys: list[str] | None) -> list[str]:
    """The scope of ``df`` and the other keys asked for."""
    return list(dict.fromkeys([*scope(df), *(keys or [])]))


def market(df: DataFrame, exchange: str, contract_type: str | None = None) -> DataFrame:
    """The rows of one exchange, and of one contract type if it is given; both filters reach the scan."""
    kept = df.where(F.col("exchange") == exchange)
    return kept.where(F.col("contract_type") == contract_type) if contract_type is not None else kept


def total(df: DataFrame, name: str = "expected") -> DataFrame:
    """The number of symbols of each market: a row for each, one in all for a table without markets."""
    return df.groupBy(*scope(df)).agg(F.count_distinct("symbol").alias(name))


def with_total(rows: DataFrame, of: DataFrame, name: str = "expected") -> DataFrame:
    """``rows`` with the number of symbols that ``of`` has in their market; no action runs for it."""
    sizes, on = total(of, name), scope(of)
    # Without markets the sizes are one row.
    return rows.join(sizes, on) if on else rows.crossJoin(F.broadcast(sizes))
