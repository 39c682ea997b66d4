"""Queries over selection by time, gaps, ingest, history, ranking and serving, with their SQL."""

from __future__ import annotations

from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config
from ..functions import scalar as S
from ..operators import bars as B
from ..operators import cointegration, correlation, gaps, history, ranking, scope, selectors, serving
from ..schema import SYMBOLS
from ..sources import vendors
from ..sources.tables import table
from .market import AS_OF, BARS, COINT, FILLED, GRID, START, by_market, hourly, market_events, r, with_rounded

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def _users(spark, sf) -> DataFrame:
    """Every tick as a one-tick candle of its user: a wide dimension of symbols."""
    return table(spark, sf, "events").select(F.col("user_id").alias("symbol"), F.col("ts").alias("start_time"), "event_id", "value")


@query("latest_per_symbol", "SELECT user_id AS symbol, max(ts) AS start_time, last(event_id ORDER BY ts, event_id) AS event_id, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1")
def latest_per_symbol(spark, sf):
    return selectors.latest(_users(spark, sf), order=["start_time", "event_id"])


@query("asof_forward", "SELECT user_id AS symbol, min(ts) AS start_time, first(event_id ORDER BY ts, event_id) AS event_id, first(value ORDER BY ts, event_id) AS value FROM events WHERE ts >= TIMESTAMP '2024-01-15 12:00:00' GROUP BY 1")
def asof_forward(spark, sf):
    return selectors.first_at_or_after(_users(spark, sf), "2024-01-15 12:00:00", order=["start_time", "event_id"])


@query("exact_at_ts", f"WITH {BARS} SELECT symbol, close, number_of_trades FROM bars WHERE start_time = TIMESTAMP '2024-01-15 12:00:00' AND symbol IN ('view', 'click', 'signup')")
def exact_at_ts(spark, sf):
    return selectors.exactly(hourly(spark, sf), "2024-01-15 12:00:00", ["view", "click", "signup"]).select("symbol", "close", "number_of_trades")


@query("multi_offset", f"WITH {BARS}, h AS (SELECT unnest([1, 4, 12, 24, 72, 168, 336]) AS hours) SELECT hours, symbol, start_time, close FROM h JOIN bars ON start_time = TIMESTAMP '2024-01-30 23:00:00' - to_hours(hours)")
def multi_offset(spark, sf):
    return selectors.hours_back(hourly(spark, sf), "2024-01-30 23:00:00", config.all_hours()).select("hours", "symbol", "start_time", "close")


@query("star_join_filter", """SELECT n_name, o_orderpriority, count(*) AS n, round(sum(l_extendedprice), 2) + 0e0 AS price FROM lineitem
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND r_name = (SELECT min(r_name) FROM region) AND o_orderstatus IN ('F', 'O') GROUP BY 1, 2""")
def star_join_filter(spark, sf):
    t = {n: table(spark, sf, n) for n in ("lineitem", "orders", "customer", "nation", "region")}
    first = t["region"].agg(F.min("r_name")).first()[0]
    lines = t["lineitem"].where("l_shipdate >= timestamp_ntz'1997-01-01' and l_shipdate < timestamp_ntz'1998-01-01'").join(t["orders"].where("o_orderstatus in ('F', 'O')"), F.col("l_orderkey") == F.col("o_orderkey"))
    region = t["region"].where(F.col("r_name") == first)
    joined = selectors.star(lines, (t["customer"], F.col("o_custkey") == F.col("c_custkey")), (t["nation"], F.col("c_nationkey") == F.col("n_nationkey")), (region, F.col("n_regionkey") == F.col("r_regionkey")))
    return joined.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), S.rounded(F.sum("l_extendedprice"), 2).alias("price"))


MINUTES = f"""mins AS (SELECT DISTINCT event_type AS symbol, date_trunc('minute', ts) AS start_time FROM events),
missing AS (SELECT symbol, start_time FROM (SELECT DISTINCT symbol FROM mins) CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{AS_OF}' - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS start_time)
  EXCEPT SELECT * FROM mins),
runs AS (SELECT symbol, min(start_time) AS range_start, max(start_time) + INTERVAL 1 MINUTE AS range_end, count(*) AS steps FROM
  (SELECT *, start_time - to_minutes(CAST(row_number() OVER (PARTITION BY symbol ORDER BY start_time) AS INTEGER)) AS run FROM missing) GROUP BY symbol, run)"""


def _missing(events: DataFrame) -> DataFrame:
    """Missing minutes of the whole grid, for every symbol of the table."""
    return gaps.missing_steps(B.bars(events, "minute"), START, AS_OF)


@query("missing_minutes", f"WITH {MINUTES} SELECT * FROM missing")
def missing_minutes(spark, sf):
    return _missing(table(spark, sf, "events"))


@query("gap_islands", f"WITH {MINUTES} SELECT * FROM runs")
def gap_islands(spark, sf):
    return gaps.islands(_missing(table(spark, sf, "events")))


@query("gap_chunks", f"""WITH {MINUTES}, c AS (SELECT symbol, range_end, unnest(generate_series(range_start, range_end - INTERVAL 1 MINUTE, INTERVAL 100 MINUTE)) AS chunk_start FROM runs)
SELECT symbol, chunk_start, least(chunk_start + INTERVAL 100 MINUTE, range_end) AS chunk_end FROM c""")
def gap_chunks(spark, sf):
    return gaps.chunks(gaps.islands(_missing(table(spark, sf, "events"))), 100)


@query("market_gap_islands", by_market(f"WITH {MINUTES} SELECT * FROM runs"))
def market_gap_islands(spark, sf):
    return gaps.islands(_missing(market_events(spark, sf)))


@query("bar_completeness", f"WITH {BARS} SELECT start_time, count(DISTINCT symbol) AS present, (SELECT count(DISTINCT symbol) FROM bars) AS expected, count(DISTINCT symbol) >= (SELECT count(DISTINCT symbol) FROM bars) AS complete FROM bars GROUP BY 1")
def bar_completeness(spark, sf):
    return gaps.completeness(hourly(spark, sf))


@query("publishable_bars", f"""WITH {BARS}, ok AS (SELECT start_time FROM bars GROUP BY 1 HAVING count(DISTINCT symbol) >= (SELECT count(DISTINCT symbol) FROM bars))
SELECT symbol, start_time, close FROM bars WHERE start_time < TIMESTAMP '2024-01-30 22:58:00' AND start_time IN (SELECT start_time FROM ok)""")
def publishable_bars(spark, sf):
    return gaps.publishable(hourly(spark, sf), "2024-01-30 23:00:00").select("symbol", "start_time", "close")


@query("payload_counts", f"""WITH {BARS}, h AS (SELECT unnest([0, 1, 4, 12, 24]) AS hours) SELECT hours, count(DISTINCT symbol) AS present, (SELECT count(DISTINCT symbol) FROM bars) AS expected
FROM h LEFT JOIN bars ON start_time = TIMESTAMP '2024-01-30 23:00:00' - to_hours(hours) GROUP BY 1""")
def payload_counts(spark, sf):
    return gaps.payload_counts(hourly(spark, sf), "2024-01-30 23:00:00", [1, 4, 12, 24])


for _name, _sql, _of in (
    ("bar_completeness", SQL["bar_completeness"], lambda e: gaps.completeness(B.bars(e))),
    ("publishable_bars", SQL["publishable_bars"], lambda e: gaps.publishable(B.bars(e), "2024-01-30 23:00:00").select("exchange", "symbol", "start_time", "close")),
    ("payload_counts", SQL["payload_counts"], lambda e: gaps.payload_counts(B.bars(e), "2024-01-30 23:00:00", [1, 4, 12, 24])),
):
    query(f"market_{_name}", by_market(_sql))(lambda spark, sf, of=_of: of(market_events(spark, sf)))


@query("market_exact_at_ts", f"WITH {BARS.replace('FROM events', 'FROM events WHERE user_id % 2 = 1')} SELECT 'okx' AS exchange, symbol, close FROM bars WHERE start_time = TIMESTAMP '2024-01-15 12:00:00'")
def market_exact_at_ts(spark, sf):
    """One exchange's candles of one time."""
    found = selectors.exactly(scope.market(B.bars(market_events(spark, sf)), "okx"), "2024-01-15 12:00:00")
    return found.select("exchange", "symbol", "close")


@query("scan_readiness", f"""WITH {BARS}, h AS (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS t),
g AS (SELECT min(t) AS gap FROM h WHERE t NOT IN (SELECT start_time FROM bars))
SELECT coalesce(gap, TIMESTAMP '{AS_OF}') AS end, gap IS NULL AND EXISTS (SELECT 1 FROM bars WHERE symbol = 'view' AND start_time = TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR AND close > 0) AS ready FROM g""")
def scan_readiness(spark, sf):
    return gaps.scan_window(hourly(spark, sf), "view", START, AS_OF, "hour")


@query("synthetic_bars", f"""WITH {BARS}, {GRID.replace('b.close FROM', 'b.open, b.close, b.base_volume, b.number_of_trades FROM')},
f AS (SELECT *, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last FROM grid)
SELECT symbol, start_time, coalesce(open, last) AS open, coalesce(close, last) AS close, {r('coalesce(base_volume, 0)')} AS base_volume, coalesce(number_of_trades, 0) AS number_of_trades, number_of_trades IS NULL AS is_synthetic FROM f WHERE last IS NOT NULL""")
def synthetic_bars(spark, sf):
    return with_rounded(B.synthetic(hourly(spark, sf), "2024-01-01 00:00:00", AS_OF).select("symbol", "start_time", "open", "close", "base_volume", "number_of_trades", "is_synthetic"))


@query("insert_ignore", f"""WITH {BARS}, old AS (SELECT symbol, start_time FROM bars WHERE start_time < TIMESTAMP '2024-01-20'),
new AS (SELECT event_type AS symbol, date_trunc('hour', ts) AS start_time, value, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-18')
SELECT symbol, start_time, first(value ORDER BY event_id) AS value, min(event_id) AS event_id FROM new WHERE (symbol, start_time) NOT IN (SELECT (symbol, start_time) FROM old) GROUP BY 1, 2""")
def insert_ignore(spark, sf):
    events = table(spark, sf, "events")
    old = B.between(hourly(spark, sf), "2024-01-01 00:00:00", "2024-01-20 00:00:00")
    new = events.where("ts >= timestamp_ntz'2024-01-18'").select(F.col("event_type").alias("symbol"), S.trunc_ntz("hour", F.col("ts")).alias("start_time"), "value", "event_id")
    return history.insert_ignore(old, new, ["symbol", "start_time"], ["event_id"])


@query("upsert_latest", """SELECT user_id AS symbol, last(value ORDER BY ts, event_id) AS value, max(ts) AS calculated_at FROM events GROUP BY 1""")
def upsert_latest(spark, sf):
    rows = table(spark, sf, "events").select(F.col("user_id").alias("symbol"), "value", F.col("ts").alias("calculated_at"))
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    return history.upsert_latest(rows.where(F.col("calculated_at") < cut), rows.where(F.col("calculated_at") >= cut), ["symbol"], "calculated_at")


@query("dimension_ids", "WITH o AS (SELECT n_name AS name, row_number() OVER (ORDER BY n_name) AS symbol_id FROM nation WHERE n_regionkey < 2) SELECT symbol_id, name FROM o UNION ALL SELECT row_number() OVER (ORDER BY n_name) + (SELECT max(symbol_id) FROM o), n_name FROM nation WHERE n_regionkey >= 2")
def dimension_ids(spark, sf):
    names = table(spark, sf, "nation").select(F.col("n_name").alias("name"), "n_regionkey")
    none = spark.createDataFrame([], "symbol_id bigint, name string")
    old = history.with_ids(names.where("n_regionkey < 2"), none, ["name"], "symbol_id")
    return history.with_ids(names, old, ["name"], "symbol_id")


@query("symbol_diff", """WITH a AS (SELECT DISTINCT user_id AS symbol FROM events WHERE ts < TIMESTAMP '2024-01-01 12:00:00'), b AS (SELECT DISTINCT user_id AS symbol FROM events WHERE ts >= TIMESTAMP '2024-01-30 18:00:00')
SELECT symbol, 'added' AS change FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT symbol, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)""")
def symbol_diff(spark, sf):
    users = _users(spark, sf)
    return history.symbol_diff(users.where("start_time < timestamp_ntz'2024-01-01 12:00:00'"), users.where("start_time >= timestamp_ntz'2024-01-30 18:00:00'"))


@query("retention_partitions", "SELECT event_id, ts FROM events WHERE date_trunc('hour', ts) >= date_trunc('hour', TIMESTAMP '2024-01-30 12:30:00' - INTERVAL 5 HOUR)")
def retention_partitions(spark, sf):
    """The hour that the limit falls into stays whole, as its partition does."""
    rows = table(spark, sf, "events").withColumn("hour_part", S.partition_hour(F.col("ts")))
    return history.keep_partitions(rows, "2024-01-30 12:30:00", 4).select("event_id", "ts")


@query("retention_rows", "SELECT event_id, ts FROM events WHERE ts >= TIMESTAMP '2024-01-30 12:30:00' - INTERVAL 12 HOUR")
def retention_rows(spark, sf):
    return history.keep_rows_since(table(spark, sf, "events"), "2024-01-30 12:30:00", 12, "ts").select("event_id", "ts")


DAILY = f"""p AS (SELECT a.symbol AS symbol1, b.symbol AS symbol2, date_trunc('day', start_time) + INTERVAL 1 DAY AS calculated_at, a.close AS x, b.close AS y FROM bars a JOIN bars b USING (start_time) WHERE a.symbol < b.symbol),
hist AS (SELECT symbol1, symbol2, calculated_at, CASE WHEN count(*) > 1 AND var_pop(x) * var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END AS c FROM p GROUP BY 1, 2, 3)"""


def _daily_corr(spark, sf) -> DataFrame:
    """Correlation of each calendar day's hourly closes: a history of pairs."""
    day = (S.trunc_ntz("day", F.col("start_time")) + F.expr("INTERVAL 1 DAY")).alias("calculated_at")
    found = correlation.pairs(B.measure(hourly(spark, sf), "price")).withColumn("calculated_at", day)
    c = correlation.pearson(F.count(F.lit(1)), F.covar_pop("x", "y"), F.var_pop("x"), F.var_pop("y"))
    return found.groupBy("symbol1", "symbol2", "calculated_at").agg(c.alias("correlation_value"))


@query("pair_history_corr", f"""WITH {BARS}, {DAILY}, s AS (SELECT * FROM (VALUES (0, 'error'), (1, 'nobody'), (2, 'signup')) v(place, symbol)),
m AS (SELECT CASE WHEN symbol1 = 'purchase' THEN symbol2 ELSE symbol1 END AS symbol, calculated_at AS time, {r('c', 3)} AS value FROM hist WHERE (symbol1 = 'purchase' OR symbol2 = 'purchase') AND calculated_at >= TIMESTAMP '2024-01-20')
SELECT CAST(place AS BIGINT) AS place, s.symbol, time, value FROM s LEFT JOIN m ON m.symbol = s.symbol""")
def pair_history_corr(spark, sf):
    return history.pair_history(_daily_corr(spark, sf), "purchase", ["error", "nobody", "purchase", "signup", "error"], "correlation_value", "2024-01-20 00:00:00", 3, True)


@query("pair_history_series", f"""WITH {BARS}, {DAILY} SELECT CASE WHEN symbol1 = 'view' THEN symbol2 ELSE symbol1 END AS symbol,
string_agg(strftime(calculated_at, '%Y-%m-%d') || '=' || CAST(CAST({r('c', 3)} AS DECIMAL(6, 3)) AS VARCHAR), ',' ORDER BY calculated_at) AS points FROM hist WHERE symbol1 = 'view' OR symbol2 = 'view' GROUP BY 1""")
def pair_history_series(spark, sf):
    pairs = history.pair_history(_daily_corr(spark, sf), "view", ["click", "error", "purchase", "signup"], "correlation_value", "2024-01-01 00:00:00", 3)
    text = F.transform("points", lambda p: F.concat(F.date_format(p["time"], "yyyy-MM-dd"), F.lit("="), p["value"].cast("decimal(6,3)").cast("string")))
    return history.series(pairs).select("symbol", F.array_join(text, ",").alias("points"))


@query("history_points", f"""WITH {BARS}, {DAILY}, s AS (SELECT * FROM (VALUES ('error'), ('nobody'), ('signup')) v(symbol)),
m AS (SELECT CASE WHEN symbol1 = 'purchase' THEN symbol2 ELSE symbol1 END AS symbol, calculated_at AS time, {r('c', 3)} AS value FROM hist WHERE (symbol1 = 'purchase' OR symbol2 = 'purchase') AND calculated_at >= TIMESTAMP '2024-01-20')
SELECT s.symbol, coalesce(string_agg(strftime(time, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00 ' || CAST(value AS VARCHAR), ',' ORDER BY time DESC), '') AS points FROM s LEFT JOIN m ON m.symbol = s.symbol GROUP BY 1""")
def history_points(spark, sf):
    """Each comparison's history as clients get it: newest first, times with their zone."""
    pairs = history.pair_history(_daily_corr(spark, sf), "purchase", ["error", "nobody", "signup"], "correlation_value", "2024-01-20 00:00:00", 3, True)
    return serving.history_points(pairs).select("symbol", F.array_join(F.transform("points", lambda p: F.array_join(p, " ")), ",").alias("points"))


@query("exchange_symbols", """WITH e AS (SELECT * FROM (VALUES ('binance', 'USDT'), ('bybit', 'USDT'), ('okx', '-USDT-SWAP'), ('hyperliquid', '')) v(exchange, suffix))
SELECT exchange, n_nationkey, upper(n_name) || suffix AS symbol FROM nation, e""")
def exchange_symbols(spark, sf):
    names = table(spark, sf, "nation").withColumn("exchange", F.explode(F.array(*[F.lit(e) for e in config.EXCHANGES])))
    return names.select("exchange", "n_nationkey", S.exchange_symbol(F.col("n_name"), F.col("exchange")).alias("symbol"))


@query("rank_top_k", "SELECT o_custkey AS symbol, round(sum(o_totalprice), 2) + 0e0 AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 20")
def rank_top_k(spark, sf):
    total = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("symbol")).agg(F.sum("o_totalprice").alias("t"))
    return ranking.top_k(total, [F.desc("t"), "symbol"], 20).select("symbol", S.rounded(F.col("t"), 2).alias("total"))


@query("rank_join", """WITH l AS (SELECT upper(n_name) AS coin, max(i) AS rank FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation) GROUP BY 1),
s AS (SELECT DISTINCT upper(n_name) || 'USDT' AS symbol FROM customer JOIN nation ON c_nationkey = n_nationkey) SELECT coin || 'USDT' AS symbol, rank FROM l WHERE coin || 'USDT' IN (SELECT symbol FROM s) ORDER BY rank, 1 LIMIT 10""")
def rank_join(spark, sf):
    nation = table(spark, sf, "nation")
    listed = nation.agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("coins"))
    traded = table(spark, sf, "customer").join(selectors.dimension(nation), F.col("c_nationkey") == F.col("n_nationkey")).select(S.coin_symbol(F.col("n_name"), "USDT").alias("symbol"))
    return ranking.ranked_symbols(ranking.ranks(listed), traded, "USDT", 10)


CHARTS = """SELECT 'heatmap' AS use, string_agg(symbol, ',' ORDER BY rank) AS symbols FROM s WHERE rank <= 50
UNION ALL SELECT 'correlation_pair_history', string_agg(symbol, ',' ORDER BY rank) FROM (SELECT * FROM s WHERE symbol <> (SELECT base FROM b) ORDER BY rank LIMIT 10)
UNION ALL SELECT 'cointegration_pair_history', string_agg(symbol, ',' ORDER BY rank) FROM (SELECT * FROM s WHERE symbol <> (SELECT base FROM b) ORDER BY rank LIMIT 5)
UNION ALL SELECT 'cointegration_live_table', string_agg(symbol, ',' ORDER BY rank) FROM s WHERE rank <= 75 UNION ALL SELECT 'price_change_percentage', base FROM b"""


@query("chart_defaults", f"""WITH c AS (SELECT 'C' || c_custkey AS symbol, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer), s AS (SELECT * FROM c WHERE rank <= 100),
b AS (SELECT symbol AS base FROM s WHERE rank = 3) {CHARTS}""")
def chart_defaults(spark, sf):
    """The hundred customers with the most money as a list by market cap; the third is the exchange's primary symbol."""
    top = ranking.top_k(table(spark, sf, "customer").select(F.concat(F.lit("C"), "c_custkey").alias("symbol"), "c_acctbal", "c_custkey"), [F.desc("c_acctbal"), "c_custkey"], 100)
    listed = top.agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("c_acctbal")).alias("m"), "c_custkey", "symbol"))), lambda x: x["symbol"]).alias("coins"))
    ranked = ranking.ranks(listed).select(F.col("coin").alias("symbol"), "rank")
    base = ranked.where("rank = 3").first()["symbol"]
    return ranking.defaults(ranked, base).select("use", F.array_join("symbols", ",").alias("symbols"))


@query("param_clean", """WITH raw AS (SELECT n_nationkey, ' ' || n_name || ' ,, ' || lower(n_name) || ',' || n_name || ', X ' AS p FROM nation)
SELECT n_nationkey, n_name AS first, CASE WHEN n_name = lower(n_name) THEN n_name || ',X' ELSE n_name || ',' || lower(n_name) || ',X' END AS cleaned FROM raw JOIN nation USING (n_nationkey)""")
def param_clean(spark, sf):
    nation = table(spark, sf, "nation")
    raw = F.concat(F.lit(" "), "n_name", F.lit(" ,, "), F.lower("n_name"), F.lit(","), "n_name", F.lit(", X "))
    return nation.select("n_nationkey", F.element_at(S.clean_params(raw), 1).alias("first"), F.array_join(S.clean_params(raw), ",").alias("cleaned"))


def _candles(spark, sf) -> DataFrame:
    """What the vendors' records are written from: a candle for each tick."""
    ms = S.floor_minute_ms(F.unix_millis(F.col("ts").cast("timestamp")))
    price = F.col("value").cast("decimal(18,8)")
    return table(spark, sf, "events").select(
        "event_id", F.col("event_type").alias("s"), ms.alias("t"), price.cast("string").alias("p"), (price * 2).cast("decimal(24,8)").cast("string").alias("v"), (price * 3).cast("decimal(24,8)").cast("string").alias("q"),
        F.get_json_object("props", "$.k").cast("bigint").alias("n"),
    )


def _shaped(rows: DataFrame) -> DataFrame:
    return rows.select("symbol", F.col("start_time").cast("timestamp_ntz").alias("start_time"), *[F.col(c).cast("double").alias(c) for c in ("close", "base_volume", "quote_volume")], "number_of_trades")


@query("vendor_json_parse", """SELECT event_type AS symbol, date_trunc('minute', ts) AS start_time, value AS close, 2 * value AS base_volume, 3 * value AS quote_volume, CAST(props ->> 'k' AS INTEGER) AS number_of_trades
FROM events""")
def vendor_json_parse(spark, sf):
    kline = F.struct("t", S.close_ms(F.col("t")).alias("T"), "s", *[F.col("p").alias(c) for c in "ohlc"], "v", "n", "q", F.lit(True).alias("x"))
    raw = _candles(spark, sf).select(F.to_json(F.struct(F.lit("kline").alias("e"), kline.alias("k"))).alias("raw"))
    return _shaped(vendors.binance_live(raw))


VALUES = "event_type AS symbol, date_trunc('minute', ts) AS start_time, value AS close, 2 * value AS base_volume"


@query("vendor_shapes", f"""SELECT vendor, {VALUES}, CASE WHEN vendor LIKE 'hyper%' THEN NULL ELSE 3 * value END AS quote_volume,
  CASE WHEN vendor LIKE 'binance%' OR vendor LIKE 'hyper%' THEN CAST(props ->> 'k' AS INTEGER) ELSE 0 END AS number_of_trades
FROM events, (SELECT unnest(['binance history', 'bybit live', 'bybit history', 'okx live', 'okx history', 'hyperliquid history']) AS vendor)""")
def vendor_shapes(spark, sf):
    """The other shapes of all vendors, live and history, from the same candles."""
    c = _candles(spark, sf)
    start, end = F.col("t").cast("string"), S.close_ms(F.col("t"))
    ohlc, text = [F.col("p")] * 4, lambda *xs: F.array(*[x.cast("string") for x in xs])
    okx = text(start, *ohlc, F.col("v"), F.lit("0"), F.col("q"), F.lit("1"))
    hyper = F.struct("t", "s", *[F.col("p").alias(x) for x in "ohlc"], "v", "n")
    bybit = F.struct(F.col("t").alias("start"), end.alias("end"), *[F.col("p").alias(x) for x in ("open", "high", "low", "close")], F.col("v").alias("volume"), F.col("q").alias("turnover"), F.lit(True).alias("confirm"))
    shapes = {
        "binance history": (vendors.binance_history, text(start, *ohlc, F.col("v"), end, F.col("q"), F.col("n"), F.lit("0"), F.lit("0"))),
        "bybit live": (vendors.bybit_live, F.struct(F.concat(F.lit("kline.1."), "s").alias("topic"), F.array(bybit).alias("data"))),
        "bybit history": (vendors.bybit_history, text(start, *ohlc, F.col("v"), F.col("q"))),
        "okx live": (vendors.okx_live, F.struct(F.struct(F.lit("candle1m").alias("channel"), F.col("s").alias("instId")).alias("arg"), F.array(okx).alias("data"))),
        "okx history": (vendors.okx_history, okx),
        "hyperliquid history": (vendors.hyperliquid_history, hyper),
    }
    parts = [_shaped(parse(c.select(F.col("s").alias("symbol"), F.to_json(record).alias("raw")))).withColumn("vendor", F.lit(name)) for name, (parse, record) in shapes.items()]
    return reduce(DataFrame.unionByName, parts)


@query("vendor_last_update", f"""WITH u AS (SELECT {VALUES}, CAST(props ->> 'k' AS INTEGER) AS number_of_trades, ts, event_id FROM events)
SELECT symbol, start_time, last(close ORDER BY ts, event_id) AS close, last(number_of_trades ORDER BY ts, event_id) AS number_of_trades FROM u GROUP BY 1, 2""")
def vendor_last_update(spark, sf):
    """Updates of a candle until its minute ends: the last one counts."""
    hyper = F.struct("t", "s", *[F.col("p").alias(x) for x in "ohlc"], "v", "n")
    ticks = table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    raw = _candles(spark, sf).join(ticks, "event_id").select(F.struct("us", "event_id").alias("arrival"), F.to_json(F.struct(F.lit("candle").alias("channel"), hyper.alias("data"))).alias("raw"))
    return _shaped(vendors.hyperliquid_live(raw)).select("symbol", "start_time", "close", "number_of_trades")


PAGES = """c AS (SELECT event_type AS symbol, date_trunc('minute', ts) AS start_time, value, event_id, CAST(date_trunc('day', ts) AS DATE) - DATE '2024-01-01' AS day FROM events),
paged AS (SELECT vendor, symbol, start_time, CASE WHEN back THEN 100 - day ELSE day END + copy AS page, value * (1 + copy) AS close
  FROM c, (VALUES ('binance', false), ('bybit', true), ('okx', true), ('hyperliquid', false)) v(vendor, back), (VALUES (0), (1)) o(copy))"""


@query("history_pages", f"""WITH {PAGES}
SELECT vendor, symbol, start_time, first(close ORDER BY page, close) AS close FROM paged
WHERE start_time >= TIMESTAMP '2024-01-02 06:00:00' AND start_time < TIMESTAMP '2024-01-29 18:00:00' AND (vendor <> 'hyperliquid' OR start_time < TIMESTAMP '2024-01-29 12:30:00') GROUP BY 1, 2, 3""")
def history_pages(spark, sf):
    """Each vendor's history of a range in pages of a day, forward or backward in time. A page has the candles of the one before it
    again, at twice the price; those of the first page count. One vendor's last minute isn't over yet."""
    c = _candles(spark, sf).withColumn("day", F.floor((F.col("t") - S.ms_of(F.lit(int(datetime(2024, 1, 1, tzinfo=timezone.utc).timestamp() * 1000)))) / 86_400_000))
    c = c.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("copy"))
    p = (F.col("p").cast("decimal(18,8)") * (F.col("copy") + 1)).cast("decimal(20,8)").cast("string")
    start, text = F.col("t").cast("string"), lambda *xs: F.array(*[x.cast("string") for x in xs])
    unused = F.lit("0")
    records = {
        "binance": text(start, p, p, p, p, F.col("v"), S.close_ms(F.col("t")), F.col("q"), F.col("n"), unused, unused), "bybit": text(start, p, p, p, p, F.col("v"), F.col("q")),
        "okx": text(start, p, p, p, p, F.col("v"), unused, F.col("q"), F.lit("1")), "hyperliquid": F.struct("t", "s", *[p.alias(x) for x in "ohlc"], "v", "n"),
    }
    parts = []
    for name, record in records.items():
        day = F.lit(100) - F.col("day") if name in ("bybit", "okx") else F.col("day")
        raw = c.select(F.col("s").alias("symbol"), (day + F.col("copy")).alias("page"), F.to_json(record).alias("raw"))
        unfinished = {"as_of_ms": int(datetime(2024, 1, 29, 12, 30, 59, tzinfo=timezone.utc).timestamp() * 1000)} if name == "hyperliquid" else {}
        parsed = vendors.HISTORY[name](raw, **unfinished)
        parsed = parsed.withColumn("start_time", F.col("start_time").cast("timestamp_ntz"))
        found = vendors.pages(parsed.select("symbol", "page", "start_time", F.col("close").cast("double").alias("close")), "2024-01-02 06:00:00", "2024-01-29 18:00:00", "page")
        parts.append(found.select(F.lit(name).alias("vendor"), "symbol", "start_time", "close"))
    return reduce(DataFrame.unionByName, parts)


@query("listed_symbols", """SELECT 'binance' AS vendor, 'C' || c_custkey || 'USDT' AS symbol FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0
UNION ALL SELECT 'bybit', 'C' || c_custkey || 'USDT' FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0
UNION ALL SELECT 'okx', 'C' || c_custkey || '-USDT-SWAP' FROM customer WHERE c_mktsegment <> 'MACHINERY' AND c_acctbal > 0
UNION ALL SELECT 'hyperliquid', 'C' || c_custkey FROM customer WHERE c_acctbal > 0""")
def listed_symbols(spark, sf):
    """Customers as listed instruments: those of one segment are of another kind, those without money aren't traded."""
    swap, live, coin = F.col("c_mktsegment") != "MACHINERY", F.col("c_acctbal") > 0, F.concat(F.lit("C"), "c_custkey")
    pick = lambda cond, yes, no: F.when(cond, yes).otherwise(no)
    usdt = F.concat(coin, F.lit("USDT")).alias("symbol")
    records = {
        "binance": F.struct(usdt, pick(swap, "PERPETUAL", "CURRENT_QUARTER").alias("contractType"), F.lit("USDT").alias("quoteAsset"), pick(live, "TRADING", "SETTLING").alias("status")),
        "bybit": F.struct(usdt, pick(swap, "LinearPerpetual", "LinearFutures").alias("contractType"), F.lit("USDT").alias("quoteCoin"), pick(live, "Trading", "Closed").alias("status")),
        "okx": F.struct(F.concat(coin, F.lit("-USDT-SWAP")).alias("instId"), pick(swap, "SWAP", "FUTURES").alias("instType"), F.lit("USDT").alias("settleCcy"), pick(live, "live", "suspend").alias("state")),
        "hyperliquid": F.struct(coin.alias("name"), F.when(~live, True).alias("isDelisted")),
    }
    listed = table(spark, sf, "customer")
    return reduce(DataFrame.unionByName, [vendors.perpetual_symbols(listed.select(F.to_json(x).alias("raw")), v).select(F.lit(v).alias("vendor"), "symbol") for v, x in records.items()])


@query("mid_prices", """SELECT 'S' || l_suppkey || '-' || l_partkey AS symbol, max(l_extendedprice) AS price FROM lineitem JOIN (SELECT DISTINCT s_suppkey FROM supplier WHERE s_acctbal >= 0) ON s_suppkey = l_suppkey GROUP BY 1""")
def mid_prices(spark, sf):
    """A snapshot of prices for each order, one JSON object, and the highest of each name: a mark in front is a spot market's, left out."""
    mark = F.when(F.col("s_acctbal") < 0, "@").otherwise("S")
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_suppkey", "l_partkey").agg(F.max("l_extendedprice").alias("price"))
    named = lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = named.select("l_orderkey", F.struct(F.concat(mark, "l_suppkey", F.lit("-"), "l_partkey").alias("k"), F.col("price").cast("string").alias("v")).alias("x"))
    raw = named.groupBy("l_orderkey").agg(F.to_json(F.map_from_entries(F.collect_list("x"))).alias("raw"))
    return vendors.mid_prices(raw).groupBy("symbol").agg(F.max("price").alias("price"))


@query("market_caps", """SELECT 'C' || c_custkey AS coin, rank, c_nationkey FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer) WHERE rank <= 250""")
def market_caps(spark, sf):
    """A list of the 250 first by market cap for each nation, as JSON."""
    by = Window.partitionBy("c_nationkey").orderBy(F.desc("c_acctbal"), "c_custkey")
    first = table(spark, sf, "customer").withColumn("place", F.row_number().over(by)).where("place <= 250")
    entries = first.select("c_nationkey", F.struct("place", F.concat(F.lit("c"), "c_custkey").alias("symbol")).alias("x"))
    raw = entries.groupBy("c_nationkey").agg(F.to_json(F.transform(F.array_sort(F.collect_list("x")), lambda x: F.struct(x["symbol"].alias("symbol")))).alias("raw"))
    return ranking.ranks(vendors.market_caps(raw, "c_nationkey"), keys=["c_nationkey"])


@query("symbols_missing_at", """SELECT DISTINCT user_id AS symbol FROM events WHERE user_id NOT IN (SELECT user_id FROM events WHERE date_trunc('day', ts) = TIMESTAMP '2024-01-15 00:00:00')""")
def symbols_missing_at(spark, sf):
    daily = _users(spark, sf).withColumn("start_time", F.date_trunc("day", "start_time").cast("timestamp_ntz"))
    return gaps.missing_symbols(daily, daily, "2024-01-15 00:00:00")


WINDOW_SQL = """m AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'binance' ELSE 'okx' END AS exchange, event_type AS symbol, date_trunc('hour', ts) AS start_time FROM events),
w AS (SELECT exchange, greatest(TIMESTAMP '2024-01-30 12:07:00' - INTERVAL 7 DAY, least(TIMESTAMP '2024-01-30 12:07:00' - INTERVAL 30 MINUTE, coalesce(max(start_time) FILTER (symbol = 'view') + INTERVAL 1 MINUTE, TIMESTAMP '2024-01-30 12:07:00'))) AS start,
  TIMESTAMP '2024-01-30 12:07:00' AS "end" FROM m WHERE start_time < TIMESTAMP '2024-01-25 12:00:00' OR exchange = 'okx' AND start_time < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 1)"""


def _known(spark, sf) -> DataFrame:
    """What a collector that stopped some days ago has of two markets, of one of them more than a backfill goes back."""
    hours = B.bars(market_events(spark, sf)).select("exchange", "symbol", "start_time")
    return hours.where((F.col("start_time") < "2024-01-25 12:00:00") | ((F.col("exchange") == "okx") & (F.col("start_time") < "2024-01-20 12:00:00")))


@query("backfill_window", f'WITH {WINDOW_SQL} SELECT exchange, start, "end" FROM w')
def backfill_window(spark, sf):
    return gaps.backfill_window(_known(spark, sf), "2024-01-30 12:07:30", "view")


@query("backfill_chunks", f"""WITH {WINDOW_SQL}, n AS (SELECT DISTINCT exchange, symbol FROM m), e AS (SELECT exchange, symbol, unnest(generate_series(start, "end" - INTERVAL 1 MINUTE, INTERVAL 1 MINUTE)) AS t FROM n JOIN w USING (exchange)),
k AS (SELECT * FROM m WHERE start_time < TIMESTAMP '2024-01-25 12:00:00' OR exchange = 'okx' AND start_time < TIMESTAMP '2024-01-20 12:00:00'),
g AS (SELECT *, epoch(t) // 60 - row_number() OVER (PARTITION BY exchange, symbol ORDER BY t) AS run FROM e WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.exchange = e.exchange AND k.symbol = e.symbol AND k.start_time = e.t)),
p AS (SELECT exchange, symbol, t, run, (row_number() OVER (PARTITION BY exchange, symbol, run ORDER BY t) - 1) // 1000 AS piece FROM g)
SELECT exchange, symbol, min(t) AS chunk_start, max(t) + INTERVAL 1 MINUTE AS chunk_end FROM p GROUP BY exchange, symbol, run, piece""")
def backfill_chunks(spark, sf):
    """What the two markets have to fetch, a thousand minutes at a time."""
    known = _known(spark, sf)
    return gaps.backfill_chunks(known, gaps.backfill_window(known, "2024-01-30 12:07:30", "view"), 1000)


@query("pairs_in_order", """SELECT least(a.event_type, b.event_type) AS symbol1, greatest(a.event_type, b.event_type) AS symbol2, count(*) AS n
FROM events a JOIN events b ON a.user_id = b.user_id AND date_trunc('minute', a.ts) = date_trunc('minute', b.ts) AND a.event_type <> b.event_type GROUP BY 1, 2""")
def pairs_in_order(spark, sf):
    """Types that a user has had in one minute, either way round, as pairs with the lesser name first."""
    minute = F.date_trunc("minute", "ts").alias("minute")
    each = lambda k: table(spark, sf, "events").select("user_id", minute, F.col("event_type").alias(f"symbol{k}")).groupBy("user_id", "minute", f"symbol{k}").agg(F.count(F.lit(1)).alias(f"n{k}"))
    both = each(1).join(each(2), ["user_id", "minute"]).where("symbol1 <> symbol2")
    return history.canonical(both).groupBy("symbol1", "symbol2").agg(F.sum(F.col("n1") * F.col("n2")).alias("n"))


@query("text_functions", """SELECT event_id, date_trunc('minute', ts) AS to_minute, date_trunc('day', ts) AS to_day, epoch_us(ts) // 1000 AS ms, user_id AS seq, (epoch_us(ts) // 1000, user_id) >= (1705276800000, 50) AS later FROM events""")
def text_functions(spark, sf):
    """Days with and without a time of day, and positions of a log, from their texts."""
    day = lambda form: S.parse_day(F.date_format("ts", form)).cast("timestamp_ntz")
    position = S.stream_position(F.concat(F.unix_millis(F.col("ts").cast("timestamp")), F.lit("-"), "user_id"))
    rows = table(spark, sf, "events").select("event_id", day("dd MMM yyyy HH:mm").alias("to_minute"), day("dd MMM yyyy").alias("to_day"), position.alias("p"))
    return rows.select("event_id", "to_minute", "to_day", "p.ms", "p.seq", (F.col("p") >= S.stream_position(F.lit("1705276800000-50"))).alias("later"))


@query("event_payloads", """SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms, value AS newest, CASE WHEN user_id % 2 = 0 THEN 2 * value END AS an_hour_back FROM events WHERE event_type <> 'error'""")
def event_payloads(spark, sf):
    """Every tick as a published event; those of a backfill (here one type) aren't sent on, and every other user has nothing of an hour ago."""
    side = lambda x: F.create_map(F.lit("x"), F.struct(x.alias("price"), x.alias("volume"), F.lit(1.0).alias("trades")))
    old = F.when(F.col("user_id") % 2 == 0, F.create_map(F.lit("1"), side(F.col("value") * 2))).otherwise(F.create_map(F.lit("4"), side(F.col("value") * 3)))
    source = F.when(F.col("event_type") == "error", "backfill").otherwise(F.concat(F.lit("live-"), "event_id"))
    event = F.struct(F.lit("klines").alias("event_type"), F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), source.alias("source"), side(F.col("value")).alias("newest"), old.alias("oldest"))
    sent = vendors.live_only(vendors.stream_events(table(spark, sf, "events").select(F.to_json(event).alias("raw"))))
    back = F.try_element_at("oldest", F.lit(1))
    return sent.select(F.substring_index("source", "-", -1).cast("bigint").alias("event_id"), "timestamp_ms", F.try_element_at("newest", F.lit("x"))["price"].alias("newest"), F.try_element_at(back, F.lit("x"))["price"].alias("an_hour_back"))


@query("json_rows", "SELECT n_nationkey, '{\"symbol\":\"' || n_name || '\",\"rank\":' || (n_nationkey + 1) || '}' AS body FROM nation")
def json_rows(spark, sf):
    nation = table(spark, sf, "nation")
    shaped = nation.select("n_nationkey", F.struct(F.col("n_name").alias("symbol"), (F.col("n_nationkey") + 1).alias("rank")).alias("s"))
    return shaped.select("n_nationkey", F.to_json("s").alias("body"))


@query("bootstrap", f"""WITH e AS (SELECT * FROM (VALUES ('binance', 'Binance', 'price,volume,trades', '1M=720,1w=168,3M=2160', 'BTCUSDT'), ('hyperliquid', 'Hyperliquid', 'price,volume,trades', '1M=720,1w=168', 'BTC'),
  ('bybit', 'Bybit', 'price,volume', '1M=720,1w=168,3M=2160', 'BTCUSDT'), ('okx', 'OKX', 'price,volume', '1M=720,1w=168,3M=2160', 'BTC-USDT-SWAP')) v(exchange, name, data_types, average, base)),
s AS (SELECT DISTINCT 'binance' AS exchange, CASE event_type WHEN 'view' THEN 'BTCUSDT' ELSE event_type END AS symbol FROM events), ranked AS (SELECT *, row_number() OVER (ORDER BY symbol DESC) AS rank FROM s),
others AS (SELECT *, row_number() OVER (ORDER BY rank) AS place FROM ranked WHERE symbol <> 'BTCUSDT')
SELECT exchange, name, data_types, 'average_price:' || average || ';cointegration_pair:4h=4,8h=8;correlation:12h=12,14d=336,1d=24,1h=1,3d=72,4h=4,7d=168;correlation_pair:1h=1,4h=4;zscore:12h=12,1h=1,4h=4' AS hours,
  coalesce((SELECT string_agg(symbol, ',' ORDER BY symbol) FROM s WHERE s.exchange = e.exchange), '') AS symbols, coalesce((SELECT string_agg(symbol, ',' ORDER BY rank) FROM ranked WHERE ranked.exchange = e.exchange AND rank <= 50), '') AS heatmap,
  base || ':' || coalesce((SELECT string_agg(symbol, ',' ORDER BY place) FROM others WHERE others.exchange = e.exchange AND place <= 10), '') AS correlation_pairs,
  base || ':' || coalesce((SELECT string_agg(symbol, ',' ORDER BY place) FROM others WHERE others.exchange = e.exchange AND place <= 5), '') || ':1440' AS cointegration_pairs,
  coalesce((SELECT string_agg(symbol, ',' ORDER BY rank) FROM ranked WHERE ranked.exchange = e.exchange AND rank <= 75), '') AS live_table,
  base AS price_change, '1d=1440' AS live_windows, '50,100,250' AS live_limits, 'abs_z,half_life,adf_t,updated' AS live_sorts FROM e""")
def bootstrap(spark, sf):
    """All of the start-up configuration; maps are written out as text in the order of their keys. One type stands for the primary symbol."""
    name = F.when(F.col("event_type") == "view", "BTCUSDT").otherwise(F.col("event_type"))
    symbols = table(spark, sf, "events").select(F.lit("binance").alias("exchange"), name.alias("symbol")).distinct()
    ranked = ranking.ranks(symbols.agg(F.sort_array(F.collect_list("symbol"), False).alias("coins")))
    ranked = ranked.select(F.lit("binance").alias("exchange"), F.when(F.col("coin") == "BTCUSDT", F.col("coin")).otherwise(F.lower("coin")).alias("symbol"), "rank")
    out = serving.bootstrap(spark, symbols, ranked)
    pairs = lambda m: F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",")
    chart = lambda use: F.col("chart_defaults")[use]
    listed = lambda use: F.array_join(chart(use)["symbols"], ",")
    text = lambda use: F.concat_ws(":", chart(use)["base_symbol"], listed(use), chart(use)["window"])
    return out.select(
        "exchange", "name", F.array_join("data_types", ",").alias("data_types"), F.array_join(F.transform(F.array_sort(F.map_keys("hours_options")), lambda k: F.concat(k, F.lit(":"), pairs(F.col("hours_options")[k]))), ";").alias("hours"),
        F.array_join("symbols", ",").alias("symbols"), text("heatmap").alias("heatmap"), text("correlation_pair_history").alias("correlation_pairs"), text("cointegration_pair_history").alias("cointegration_pairs"),
        text("cointegration_live_table").alias("live_table"), text("price_change_percentage").alias("price_change"),
        pairs("live_table.window_options").alias("live_windows"), F.array_join(F.col("live_table.limit_options").cast("array<string>"), ",").alias("live_limits"), F.array_join("live_table.sort_keys", ",").alias("live_sorts"),
    )


# The symbol dimension of the two markets, and tables that name symbols by identifier.
DIMENSION = """dim AS (SELECT row_number() OVER (ORDER BY exchange, name) AS symbol_id, name, exchange, 'perpetual' AS contract_type
  FROM (SELECT DISTINCT CASE WHEN user_id % 2 = 0 THEN 'binance' ELSE 'okx' END AS exchange, event_type AS name FROM events))"""


def _dimension(spark, sf) -> DataFrame:
    names = market_events(spark, sf).select(F.col("event_type").alias("name"), "exchange", F.lit("perpetual").alias("contract_type")).distinct()
    none = spark.createDataFrame([], SYMBOLS)
    return history.with_ids(names, none, ["exchange", "name", "contract_type"], "symbol_id")


@query("latest_named", f"""WITH {DIMENSION}, l AS (SELECT CASE WHEN user_id % 2 = 0 THEN 'binance' ELSE 'okx' END AS exchange, event_type AS symbol, max(ts) AS seen, last(value ORDER BY ts, event_id) AS value FROM events GROUP BY 1, 2)
SELECT symbol, exchange, 'perpetual' AS contract_type, seen, value FROM l""")
def latest_named(spark, sf):
    """A history that names symbols by identifier, joined with their names and markets."""
    dim = _dimension(spark, sf)
    rows = market_events(spark, sf).select("exchange", F.col("event_type").alias("name"), F.col("ts").alias("seen"), "event_id", "value")
    stored = selectors.latest(rows.join(dim, ["exchange", "name"]).select("symbol_id", "seen", "event_id", "value"), ["symbol_id"], ["seen", "event_id"])
    return selectors.with_symbol(stored.drop("event_id"), dim)


@query("coint_live_named", f"""SELECT exchange, 'perpetual' AS contract_type, symbol1, symbol2, spread_z FROM ({by_market(f"WITH {BARS}, {GRID}, {FILLED}, {COINT} SELECT symbol1, symbol2, {r('spread_z')} AS spread_z FROM scan")})""")
def coint_live_named(spark, sf):
    """The live table's pairs by identifier, joined with the same dimension twice."""
    dim = _dimension(spark, sf).drop("contract_type")
    found = cointegration.scan(B.bars(market_events(spark, sf)), START, AS_OF)
    for k in ("1", "2"):
        found = found.join(selectors.dimension(dim.select(F.col("symbol_id").alias(f"symbol{k}_id"), F.col("name").alias(f"symbol{k}"), "exchange")), ["exchange", f"symbol{k}"])
    return with_rounded(selectors.with_both_symbols(found.select("symbol1_id", "symbol2_id", "spread_z"), _dimension(spark, sf)))


SCANS = ["2024-01-28 00:00:00", "2024-01-29 00:00:00", "2024-01-30 00:00:00"]


def _scan_sql(end: str) -> str:
    start = f"TIMESTAMP '{end}' - INTERVAL 72 HOUR"
    day = GRID.replace(f"TIMESTAMP '{START}'", start).replace(f"TIMESTAMP '{AS_OF}'", f"TIMESTAMP '{end}'").replace("(SELECT DISTINCT symbol FROM bars)", f"(SELECT DISTINCT symbol FROM bars WHERE start_time >= {start} AND start_time < TIMESTAMP '{end}')")
    return f"SELECT *, TIMESTAMP '{end}' AS calculated_at FROM (WITH {BARS}, {day}, {FILLED}, {COINT} SELECT symbol1, symbol2, spread_z, half_life FROM scan)"


@query("pair_history_coint", f"""WITH hist AS ({' UNION ALL '.join(map(_scan_sql, SCANS))}), s AS (SELECT * FROM (VALUES (0, 'error'), (1, 'nobody'), (2, 'view')) v(place, symbol)),
m AS (SELECT CASE WHEN symbol1 = 'purchase' THEN symbol2 ELSE symbol1 END AS symbol, calculated_at AS time, {r('spread_z', 3)} AS value FROM hist WHERE symbol1 = 'purchase' OR symbol2 = 'purchase')
SELECT CAST(place AS BIGINT) AS place, s.symbol, time, value FROM s LEFT JOIN m ON m.symbol = s.symbol""")
def pair_history_coint(spark, sf):
    """What three daily scans of 72 hours have left in the history; a scan of another window isn't of it."""
    bars, scans = hourly(spark, sf), []
    for end in SCANS:
        stop = F.lit(end).cast("timestamp_ntz")
        scans.append(cointegration.scan(bars, stop - S.hours(72), stop).withColumn("calculated_at", stop).withColumn("window_minutes", F.lit(72 * 60)))
    other = scans[0].withColumn("window_minutes", F.lit(1440))
    return history.coint_history(reduce(DataFrame.unionByName, [*scans, other]), "purchase", ["error", "nobody", "view"], "spread_z", "2024-01-20 00:00:00", 72 * 60)


@query("flat_triangle_index", """WITH n AS (SELECT n_nationkey AS i FROM nation), c AS (SELECT count(*) AS k FROM nation)
SELECT a.i AS i, b.i AS j, CAST(least(a.i, b.i) * k - least(a.i, b.i) * (least(a.i, b.i) + 1) // 2 + greatest(a.i, b.i) - least(a.i, b.i) - 1 AS BIGINT) AS place FROM n a, n b, c WHERE a.i <> b.i""")
def flat_triangle_index(spark, sf):
    nation = table(spark, sf, "nation")
    keys = nation.agg(F.array_sort(F.collect_set("n_nationkey")).alias("k"))
    both = keys.select("k", F.explode("k").alias("i")).select(F.size("k").alias("n"), "i", F.explode("k").alias("j")).where("i <> j")
    return both.select("i", "j", S.triangle_index(F.col("i"), F.col("j"), F.col("n")).alias("place"))


@query("time_functions", f"""SELECT event_id, epoch_us(ts) // 1000 AS ms, CAST(epoch_us(ts) // 60000000 * 60000 + 59999 AS BIGINT) AS close_ms, strftime(ts, '%H:%M') AS hh_mm, strftime(ts, '%Y%m%d%H') AS hour_part,
  to_timestamp(CAST(epoch_us(ts) // 900000000 * 900 AS BIGINT))::TIMESTAMP AS run_at, CAST(extract('dow' FROM ts) AS BIGINT) AS dow FROM events""")
def time_functions(spark, sf):
    t = F.col("ts").cast("timestamp")
    ms = F.unix_millis(t)
    return table(spark, sf, "events").select(
        "event_id", ms.alias("ms"), S.close_ms(S.floor_minute_ms(ms)).alias("close_ms"), F.date_format("ts", "HH:mm").alias("hh_mm"), S.partition_hour(F.col("ts")).alias("hour_part"),
        S.cadence_floor(F.col("ts"), 15).cast("timestamp_ntz").alias("run_at"), S.day_of_week(F.col("ts")).alias("dow"),
    )
