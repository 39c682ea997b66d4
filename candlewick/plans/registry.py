"""All queries of the engine and their SQL."""

from __future__ import annotations

from . import market, records, streams

QUERIES = market.QUERIES | records.QUERIES | streams.QUERIES
SQL = market.SQL | records.SQL | streams.SQL
FLAGSHIP = "coint_live_table_abs_z"
