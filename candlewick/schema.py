"""Schemas of the stored tables (Spark DDL)."""

KLINES = (
    "exchange string, contract_type string, symbol string, start_time timestamp, close_time timestamp, "
    "open decimal(18,8), high decimal(18,8), low decimal(18,8), close decimal(18,8), base_volume decimal(24,8), "
    "quote_volume decimal(24,8), taker_buy_base_volume decimal(24,8), taker_buy_quote_volume decimal(24,8), number_of_trades int"
)
KLINES_KEY = ["exchange", "symbol", "start_time"]
SYMBOLS = "symbol_id bigint, name string, exchange string, contract_type string"
