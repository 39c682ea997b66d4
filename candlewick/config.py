"""Exchanges, windows, measures and the live table's columns."""

from __future__ import annotations

#: measure -> candle column
MEASURES = {"price": "close", "volume": "base_volume", "trades": "number_of_trades"}

CORRELATION_HOURS = {"1h": 1, "4h": 4, "12h": 12, "1d": 24, "3d": 72, "7d": 168, "14d": 336}
CORRELATION_PAIR_HOURS = {"1h": 1, "4h": 4}
COINTEGRATION_PAIR_HOURS = {"4h": 4, "8h": 8}
ZSCORE_HOURS = {"1h": 1, "4h": 4, "12h": 12}
AVERAGE_PRICE_HOURS = {"1w": 168, "1M": 720, "3M": 2160}

EXCHANGES = {
    "binance": {"active": True, "name": "Binance", "data_types": ["price", "volume", "trades"], "chunk": 1500, "average_price": ["1w", "1M", "3M"], "primary_symbol": "BTCUSDT"},
    "hyperliquid": {"active": True, "name": "Hyperliquid", "data_types": ["price", "volume", "trades"], "chunk": 5000, "average_price": ["1w", "1M"], "primary_symbol": "BTC"},
    "bybit": {"active": True, "name": "Bybit", "data_types": ["price", "volume"], "chunk": 1000, "average_price": ["1w", "1M", "3M"], "primary_symbol": "BTCUSDT"},
    "okx": {"active": True, "name": "OKX", "data_types": ["price", "volume"], "chunk": 100, "average_price": ["1w", "1M", "3M"], "primary_symbol": "BTC-USDT-SWAP"},
}

#: A chart, how many symbols it starts with, and whether the primary symbol is left out of them.
CHART_DEFAULTS = [("heatmap", 50, False), ("correlation_pair_history", 10, True), ("cointegration_pair_history", 5, True), ("cointegration_live_table", 75, False)]
#: Charts of pairs: whether they have a window of their own, beside the primary symbol as their base.
PAIR_CHARTS = {"correlation_pair_history": False, "cointegration_pair_history": True}
RETENTION_HOURS = {"correlation": 4, "cointegration": 8, "zscore": 12}
BACKFILL_DAYS = 7
MARKET_CAP_TOP = 100
#: What an exchange's symbols have after the coin; all others have COIN_SUFFIX.
COIN_SUFFIX, COIN_SUFFIXES = "USDT", {"hyperliquid": "", "okx": "-USDT-SWAP"}
COINTEGRATION_CADENCE_MINUTES = 15
LIVE_WINDOWS, LIVE_LIMITS = {"1d": 1440}, [50, 100, 250]
#: sort key -> (descending by default)
LIVE_SORTS = {"abs_z": True, "half_life": False, "adf_t": False, "updated": True}
#: metric -> decimals of the pair history
PAIR_METRICS = {"spread_z": 3, "half_life": 2, "adf_t": 3, "hedge_ratio": 3, "spread_std": 3}


def all_hours() -> list[int]:
    """All windows in use, each once."""
    return sorted({*CORRELATION_HOURS.values(), *ZSCORE_HOURS.values()})
