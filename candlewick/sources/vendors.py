"""Vendor candles as landed JSON: one select for each vendor's live and history shapes, into one normal form.

A record that doesn't parse, or lacks a time or a price, is dropped. Each function takes rows with the JSON in ``raw``
(history also with ``symbol``, and with ``page`` where a range came in pages, which is kept for ``pages``) and works on batch and streaming frames alike, but for ``hyperliquid_live``, whose streaming
form is ``streaming.queries.last_updates``. A record is parsed once: filters on what was parsed stay above it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import at, close_ms, decimal_of, floor_minute_ms, ms_of
from ..operators.scope import series
from ..schema import KLINES

OPTIONAL = ["quote_volume", "taker_buy_base_volume", "taker_buy_quote_volume"]


def _normal(rows: DataFrame, open_time: Column, close_time: Column, symbol: Column, prices: list[Column], base: Column, trades: Column, *optional: Column, beside: tuple[str, ...] = ()) -> DataFrame:
    """The normal form: times, decimals, trades; ``optional`` are the last three volumes, null if not given."""
    more = [*optional, *[F.lit(None).cast("string")] * (3 - len(optional))]
    out = rows.select(
        *beside,
        symbol.alias("symbol"),
        F.timestamp_millis(open_time).alias("start_time"),
        F.timestamp_millis(close_time).alias("close_time"),
        *[decimal_of(p).alias(n) for p, n in zip(prices, ("open", "high", "low", "close"))],
        decimal_of(base, 24).alias("base_volume"),
        *[decimal_of(m, 24).alias(n) for m, n in zip(more, OPTIONAL)],
        F.coalesce(trades, F.lit(0)).cast("int").alias("number_of_trades"),
    )
    return out.where("symbol is not null and start_time is not null and open is not null and high is not null and low is not null and close is not null")


def _parsed(schema: str) -> Column:
    """The parsed record as a row of its own: what follows can't be pushed below, where it would be parsed again."""
    return F.explode(F.array(F.from_json("raw", schema)))


def _page(raw: DataFrame) -> tuple[str, ...]:
    return ("page",) if "page" in raw.columns else ()


def _at(array: str | Column, i: int) -> Column:
    return F.try_element_at(F.col(array) if isinstance(array, str) else array, F.lit(i + 1))


def binance_live(raw: DataFrame) -> DataFrame:
    # Keys that differ by case alone: a map keeps them apart, and one parse gives them all.
    rows = raw.select(_parsed("e string, k map<string,string>").alias("m")).where("m.e = 'kline'").select("m.k")
    get = lambda name: F.try_element_at("k", F.lit(name))
    long = lambda name: get(name).try_cast("bigint")
    return _normal(rows.where(get("x") == "true"), long("t"), long("T"), get("s"), [get(c) for c in "ohlc"], get("v"), long("n"), get("q"), get("V"), get("Q"))


def binance_history(raw: DataFrame) -> DataFrame:
    rows = raw.select("symbol", *_page(raw), _parsed("array<string>").alias("a")).where(F.size("a") >= 11)
    a = [_at("a", i) for i in range(11)]
    return _normal(rows, a[0].try_cast("bigint"), a[6].try_cast("bigint"), F.col("symbol"), a[1:5], a[5], a[8].try_cast("bigint"), a[7], a[9], a[10], beside=_page(raw))


def bybit_live(raw: DataFrame) -> DataFrame:
    item = "array<struct<start:bigint,end:bigint,open:string,high:string,low:string,close:string,volume:string,turnover:string,confirm:boolean>>"
    rows = raw.select(_parsed(f"topic string, data {item}").alias("m")).select(F.split("m.topic", r"\.").alias("topic"), F.explode("m.data").alias("d"))
    d = F.col("d")
    return _normal(rows.where(d["confirm"] & F.startswith(_at("topic", 0), F.lit("kline"))), d["start"], d["end"], _at("topic", 2), [d[c] for c in ("open", "high", "low", "close")], d["volume"], F.lit(0), d["turnover"])


def bybit_history(raw: DataFrame) -> DataFrame:
    rows = raw.select("symbol", *_page(raw), _parsed("array<string>").alias("a")).where(F.size("a") >= 7)
    a = [_at("a", i) for i in range(7)]
    start = a[0].try_cast("bigint")
    return _normal(rows, start, close_ms(start), F.col("symbol"), a[1:5], a[5], F.lit(0), a[6], beside=_page(raw))


def _okx(rows: DataFrame) -> DataFrame:
    a = [_at("a", i) for i in range(9)]
    start = a[0].try_cast("bigint")
    return _normal(rows.where((F.size("a") >= 9) & (a[8] == "1")), start, close_ms(start), F.col("symbol"), a[1:5], a[5], F.lit(0), a[7], beside=_page(rows))


def okx_live(raw: DataFrame) -> DataFrame:
    rows = raw.select(_parsed("arg struct<channel:string,instId:string>, data array<array<string>>").alias("m")).where("m.arg.channel = 'candle1m'")
    return _okx(rows.select(F.col("m.arg.instId").alias("symbol"), F.explode("m.data").alias("a")))


def okx_history(raw: DataFrame) -> DataFrame:
    return _okx(raw.select("symbol", *_page(raw), _parsed("array<string>").alias("a")))


HYPERLIQUID = "t bigint, s string, o string, h string, l string, c string, v string, n bigint"


def _hyperliquid(rows: DataFrame, *beside: str) -> DataFrame:
    start = floor_minute_ms(ms_of(F.col("d.t")))
    d = F.col("d")
    return _normal(rows, start, close_ms(start), d["s"], [d[c] for c in "ohlc"], d["v"], d["n"], beside=beside)


def hyperliquid_live(raw: DataFrame, order: str = "arrival") -> DataFrame:
    """The last update of each symbol and minute; updates of a minute once a later one has begun count as late.

    ``raw`` needs the column ``order``, in which updates arrived.
    """
    parsed = hyperliquid_updates(raw, order)
    newest = F.max("start_time").over(Window.partitionBy("symbol").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    kept = parsed.withColumn("newest", newest).where(F.col("start_time") >= F.col("newest")).drop("newest")
    rest = [c for c in kept.columns if c not in ("symbol", "start_time", order)]
    last = kept.groupBy("symbol", "start_time").agg(F.max_by(F.struct(*rest), order).alias("r"))
    return last.select("symbol", "start_time", *[F.col("r")[c].alias(c) for c in rest])


def hyperliquid_updates(raw: DataFrame, order: str = "arrival") -> DataFrame:
    """Every update in the normal form, beside the column ``order``."""
    fields = HYPERLIQUID.replace(" ", ":").replace(",:", ",")
    rows = raw.select(order, _parsed(f"channel string, data struct<{fields}>").alias("m")).where("m.channel = 'candle'").select(order, F.col("m.data").alias("d"))
    return _hyperliquid(rows, order)


def hyperliquid_history(raw: DataFrame, as_of_ms: int | None = None) -> DataFrame:
    """Whole minutes only: those that ended before the minute of ``as_of_ms``."""
    out = _hyperliquid(raw.select(*_page(raw), _parsed(HYPERLIQUID).alias("d")), *_page(raw))
    return out.where(F.col("close_time") < F.timestamp_millis(floor_minute_ms(F.lit(as_of_ms)))) if as_of_ms is not None else out


LIVE = {"binance": binance_live, "bybit": bybit_live, "okx": okx_live, "hyperliquid": hyperliquid_live}
HISTORY = {"binance": binance_history, "bybit": bybit_history, "okx": okx_history, "hyperliquid": hyperliquid_history}


def klines(candles: DataFrame, exchange: str, contract_type: str = "perpetual") -> DataFrame:
    """Candles in the normal form as rows of the stored table, of one market."""
    named = candles.withColumns({"exchange": F.lit(exchange), "contract_type": F.lit(contract_type)})
    return named.select(*[F.col(n).cast(kind).alias(n) for n, kind in (c.split(" ", 1) for c in KLINES.split(", "))])


def pages(candles: DataFrame, start: str | Column, end: str | Column | None = None, page: str | None = None) -> DataFrame:
    """Landed history pages as one range: pages overlap, so keys repeat; the one of the first page counts.

    ``page`` is the column of the page's number; without it, or on one page, the candle that closes first counts, and of
    those the one with the least values.
    """
    kept = candles.where(F.col("start_time") >= at(start))
    kept = kept.where(F.col("start_time") < at(end)) if end is not None else kept
    keys = [*series(kept), "start_time"]
    rest = [c for c in kept.columns if c not in keys and c != page]
    order = F.struct(*([page] if page else []), *(["close_time"] if "close_time" in rest else []), *rest)
    first = kept.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("r"))
    return first.select(*[F.col(c) if c in keys else F.col("r")[c].alias(c) for c in candles.columns if c != page])


def perpetual_symbols(listed: DataFrame, vendor: str) -> DataFrame:
    """symbol of each tradable perpetual contract, from one listed instrument in JSON (``raw``) a row."""
    get = lambda path: F.get_json_object("raw", f"$.{path}")
    rule = {
        "binance": (get("symbol"), (get("contractType") == "PERPETUAL") & (get("quoteAsset") == "USDT") & (get("status") == "TRADING")),
        "bybit": (get("symbol"), (get("contractType") == "LinearPerpetual") & (get("quoteCoin") == "USDT") & (get("status") == "Trading")),
        "okx": (get("instId"), (get("instType") == "SWAP") & (get("settleCcy") == "USDT") & (get("state") == "live")),
        "hyperliquid": (get("name"), F.coalesce(get("isDelisted"), F.lit("false")) != "true"),
    }[vendor]
    return listed.where(rule[1]).select(rule[0].alias("symbol")).where("symbol is not null").distinct()


def mid_prices(raw: DataFrame) -> DataFrame:
    """symbol, price of a snapshot that is one JSON object of symbols and prices."""
    each = raw.select(F.explode(F.from_json("raw", "map<string,string>")).alias("symbol", "text"))
    return each.select("symbol", F.col("text").try_cast("double").alias("price")).where("price is not null and symbol not like '@%'")


def market_caps(raw: DataFrame, *beside: str) -> DataFrame:
    """coins: the list's coin symbols in order, for ``operators.ranking.ranks``; the columns ``beside`` stay."""
    return raw.select(*beside, F.transform(F.from_json("raw", "array<struct<symbol:string>>"), lambda x: x["symbol"]).alias("coins"))


def live_only(events: DataFrame) -> DataFrame:
    """Events that go to the history: those of a backfill only bring the state up to date."""
    return events.where(F.coalesce("source", F.lit("")) != "backfill")


def stream_events(raw: DataFrame) -> DataFrame:
    """Published events: timestamp_ms, source, newest and oldest values; events without a time are ignored.

    The keys of ``oldest`` may be numbers or strings; they are numbers here.
    """
    value = "struct<price:double,volume:double,trades:double>"
    parsed = raw.select(F.from_json("raw", f"event_type string, timestamp_ms bigint, source string, newest map<string,{value}>, oldest map<string,map<string,{value}>>").alias("m"))
    rows = parsed.select("m.*").where("timestamp_ms is not null")
    return rows.withColumn("oldest", F.transform_keys("oldest", lambda k, v: k.try_cast("int")))
