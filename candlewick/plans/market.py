"""Queries over candles, seasonality, correlation, cointegration and z-scores, with their SQL.

Symbols are the event types, candles are hourly, and every query stands at AS_OF, never at the clock.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..operators import bars as B
from ..operators import cointegration, correlation, seasonality, zscore
from ..sources import layout
from ..sources.tables import table, work

START, AS_OF = "2024-01-01 00:00:00", "2024-01-31 00:00:00"
ALL_HOURS = 720
DIGITS = 6

BARS = """bars AS (
  SELECT event_type AS symbol, date_trunc('hour', ts) AS start_time, first(value ORDER BY ts, event_id) AS open, max(value) AS high,
         min(value) AS low, last(value ORDER BY ts, event_id) AS close, sum(value) AS base_volume, count(*) AS number_of_trades
  FROM events GROUP BY 1, 2)"""
LONG = """long AS (
  SELECT symbol, start_time, 'price' AS measure, close AS value FROM bars UNION ALL
  SELECT symbol, start_time, 'volume', base_volume FROM bars UNION ALL
  SELECT symbol, start_time, 'trades', CAST(number_of_trades AS DOUBLE) FROM bars)"""
GRID = f"""grid AS (
  SELECT s.symbol, t.start_time, b.close FROM (SELECT DISTINCT symbol FROM bars) s
  CROSS JOIN (SELECT unnest(generate_series(TIMESTAMP '{START}', TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR, INTERVAL 1 HOUR)) AS start_time) t
  LEFT JOIN bars b ON b.symbol = s.symbol AND b.start_time = t.start_time)"""
FILLED = """filled AS (
  SELECT symbol, start_time, coalesce(
    last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close
  FROM grid)"""


def r(x: str, digits: int = DIGITS) -> str:
    return f"round({x}, {digits}) + 0e0"


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return B.bars(table(spark, sf, "events"))


def gridded(spark: SparkSession, sf: str) -> DataFrame:
    return B.on_grid(hourly(spark, sf), START, AS_OF)


def with_rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    return df.withColumns({f.name: rounded(F.col(f.name), digits) for f in df.schema if f.dataType.simpleString() == "double"})


QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


@query("bars_hourly", f"WITH {BARS} SELECT symbol, start_time, open, high, low, close, {r('base_volume')} AS base_volume, number_of_trades FROM bars")
def bars_hourly(spark, sf):
    return with_rounded(hourly(spark, sf))


@query("bars_minutely", f"WITH {BARS.replace(chr(39) + 'hour' + chr(39), chr(39) + 'minute' + chr(39))} SELECT symbol, start_time, open, high, low, close, {r('base_volume')} AS base_volume, number_of_trades FROM bars")
def bars_minutely(spark, sf):
    return with_rounded(B.bars(table(spark, sf, "events"), "minute"))


@query("unpivot_measures", f"WITH {BARS}, {LONG} SELECT symbol, start_time, measure, {r('value')} AS value FROM long")
def unpivot_measures(spark, sf):
    return with_rounded(B.unpivot(hourly(spark, sf)))


def _season(kind: str, part: str, n: int, label: str) -> str:
    return f"""WITH {BARS}, p AS (
  SELECT symbol, date_trunc('{kind}', start_time) AS p, first(open ORDER BY start_time) AS o, last(close ORDER BY start_time) AS c FROM bars
  WHERE start_time >= date_trunc('{kind}', TIMESTAMP '{AS_OF}' - INTERVAL {ALL_HOURS} HOUR) AND start_time < date_trunc('{kind}', TIMESTAMP '{AS_OF}') + INTERVAL 1 {kind} GROUP BY 1, 2),
m AS (SELECT symbol, CAST(extract('{part}' FROM p) AS BIGINT) AS period, avg(CASE WHEN c <> 0 THEN (c - o) / c * 100 END) AS mean FROM p GROUP BY 1, 2),
e AS (SELECT symbol, unnest(range({n})) AS period FROM (SELECT DISTINCT symbol FROM bars))
SELECT e.symbol, e.period, {label} AS label, {r('coalesce(mean, 0)')} AS value, coalesce(mean, 0) > 0 AS positive FROM e LEFT JOIN m USING (symbol, period)"""


@query("seasonality_dow", _season("day", "dow", 7, "['Sun','Mon','Tue','Wed','Thu','Fri','Sat'][e.period + 1]"))
def seasonality_dow(spark, sf):
    return seasonality.seasonality(hourly(spark, sf), "day", AS_OF, ALL_HOURS, DIGITS)


@query("seasonality_hour", _season("hour", "hour", 24, "lpad(CAST(e.period AS VARCHAR), 2, '0') || ':00'"))
def seasonality_hour(spark, sf):
    return seasonality.seasonality(hourly(spark, sf), "hour", AS_OF, ALL_HOURS, DIGITS)


@query("seasonality_orders_dow", """WITH d AS (
  SELECT o_orderpriority AS symbol, date_trunc('day', o_orderdate) AS p, first(o_totalprice ORDER BY o_orderdate, o_orderkey) AS o, last(o_totalprice ORDER BY o_orderdate, o_orderkey) AS c
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY 1, 2)
SELECT symbol, CAST(extract('dow' FROM p) AS BIGINT) AS period, round(avg((c - o) / c * 100), 4) + 0e0 AS change, count(*) AS days FROM d WHERE c <> 0 GROUP BY 1, 2""")
def seasonality_orders_dow(spark, sf):
    """All of the orders, from the first day to the last."""
    from ..functions.scalar import day_of_week

    orders = table(spark, sf, "orders")
    first, last = orders.agg(F.min("o_orderdate"), F.max("o_orderdate")).first()
    daily = B.bars(orders, "day", "o_orderpriority", "o_orderdate", "o_totalprice", "o_orderkey")
    found = seasonality.changes(daily, "day", str(last or AS_OF), ((last - first).days + 1) * 24 if last else 0)
    return found.groupBy("symbol", day_of_week(F.col("period_start")).alias("period")).agg(rounded(F.avg("change"), 4).alias("change"), F.count(F.lit(1)).alias("days"))


@query("grid_hourly", f"WITH {BARS}, {GRID} SELECT symbol, start_time, close, CAST(epoch(start_time - TIMESTAMP '{START}') AS BIGINT) // 3600 AS step FROM grid")
def grid_hourly(spark, sf):
    from ..functions.scalar import at, step_index

    return gridded(spark, sf).select("symbol", "start_time", "close", step_index(F.col("start_time"), at(START), 3600).alias("step"))


@query("grid_filled", f"WITH {BARS}, {GRID}, {FILLED} SELECT * FROM filled")
def grid_filled(spark, sf):
    return B.filled(gridded(spark, sf).select("symbol", "start_time", "close"), ["close"])


@query("value_hours_back_lag", f"WITH {BARS}, {GRID} SELECT symbol, start_time, close, lag(close, 24) OVER (PARTITION BY symbol ORDER BY start_time) AS day_before FROM grid")
def value_hours_back_lag(spark, sf):
    from ..operators.selectors import lagged

    return lagged(gridded(spark, sf).select("symbol", "start_time", "close"), "close", 24, "day_before")


PEARSON = "CASE WHEN count(*) > 1 AND var_pop(x) * var_pop(y) > 0 THEN covar_pop(x, y) / sqrt(var_pop(x) * var_pop(y)) ELSE 0 END"
WINDOWS = [24, 72, 168, 336]


def _pairs(where: str) -> str:
    return f"""p AS (SELECT a.measure, a.start_time, a.symbol AS symbol1, b.symbol AS symbol2, a.value AS x, b.value AS y
  FROM long a JOIN long b ON a.measure = b.measure AND a.start_time = b.start_time AND a.symbol < b.symbol WHERE {where}),
names AS (SELECT DISTINCT measure, symbol FROM long), every AS (SELECT a.measure, a.symbol AS symbol1, b.symbol AS symbol2 FROM names a JOIN names b ON a.measure = b.measure AND a.symbol < b.symbol)"""


@query("corr_matrix", "WITH " + ", ".join([BARS, LONG, _pairs(f"a.start_time < TIMESTAMP '{AS_OF}'"), "w AS (SELECT unnest([24, 72, 168, 336]) AS hours)", f"""f AS (
  SELECT measure, hours, symbol1, symbol2, count(*) AS n, {PEARSON} AS c FROM p JOIN w ON p.start_time >= TIMESTAMP '{AS_OF}' - to_hours(w.hours) GROUP BY ALL)"""]) + f"""
SELECT measure, hours, symbol1, symbol2, coalesce(n, 0) AS n, {r('coalesce(c, 0)')} AS correlation FROM (every CROSS JOIN w) LEFT JOIN f USING (measure, hours, symbol1, symbol2)""")
def corr_matrix(spark, sf):
    return with_rounded(correlation.matrix(B.unpivot(hourly(spark, sf)), AS_OF, WINDOWS, ["measure"]))


@query("corr_rolling_24h", f"""WITH {BARS}, {GRID}, p AS (
  SELECT a.symbol AS symbol1, b.symbol AS symbol2, start_time, CASE WHEN b.close IS NOT NULL THEN a.close END AS x, CASE WHEN a.close IS NOT NULL THEN b.close END AS y
  FROM grid a JOIN grid b USING (start_time) WHERE a.symbol < b.symbol),
m AS (SELECT symbol1, symbol2, start_time, count(x) OVER w AS n, covar_pop(x, y) OVER w AS c, var_pop(x) OVER w AS vx, var_pop(y) OVER w AS vy FROM p
  WINDOW w AS (PARTITION BY symbol1, symbol2 ORDER BY start_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT symbol1, symbol2, start_time, n, {r('CASE WHEN n > 1 AND vx * vy > 0 THEN c / sqrt(vx * vy) ELSE 0 END')} AS correlation FROM m""")
def corr_rolling_24h(spark, sf):
    return with_rounded(correlation.rolling(B.measure(gridded(spark, sf), "price"), 24))


ONE = f"long AS (SELECT 'price' AS measure, symbol, start_time, close AS value FROM bars WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 168 HOUR AND start_time < TIMESTAMP '{AS_OF}')"
REQUEST = ["view", "click", "nobody", "purchase", "view"]


@query("corr_submatrix", f"""WITH {BARS}, {ONE}, {_pairs('true')}, f AS (SELECT symbol1 AS a, symbol2 AS b, {PEARSON} AS c FROM p GROUP BY 1, 2),
s AS (SELECT * FROM (VALUES (0, 'view'), (1, 'click'), (2, 'purchase')) v(i, symbol))
SELECT CAST(x.i * 3 - x.i * (x.i + 1) // 2 + y.i - x.i - 1 AS BIGINT) AS place, x.symbol AS symbol1, y.symbol AS symbol2, {r('f.c', 3)} AS correlation
FROM s x JOIN s y ON x.i < y.i JOIN f ON f.a = least(x.symbol, y.symbol) AND f.b = greatest(x.symbol, y.symbol)""")
def corr_submatrix(spark, sf):
    return correlation.submatrix(correlation.matrix(B.measure(hourly(spark, sf), "price"), AS_OF, [168]), REQUEST)


@query("corr_triangle", f"""WITH {BARS}, {ONE}, {_pairs('true')}, f AS (SELECT every.symbol1, every.symbol2, coalesce({PEARSON}, 0) AS c FROM every LEFT JOIN p USING (symbol1, symbol2) GROUP BY 1, 2)
SELECT (SELECT string_agg(symbol, ',' ORDER BY symbol) FROM (SELECT DISTINCT symbol FROM long)) AS symbols, string_agg(CAST(CAST({r('c', 4)} AS DECIMAL(8, 4)) AS VARCHAR), ',' ORDER BY symbol1, symbol2) AS values FROM f""")
def corr_triangle(spark, sf):
    flat = correlation.triangle(correlation.matrix(B.measure(hourly(spark, sf), "price"), AS_OF, [168]))
    return flat.select(F.array_join("symbols", ",").alias("symbols"), F.array_join(F.transform("values", lambda v: rounded(v, 4).cast("decimal(8,4)").cast("string")), ",").alias("values"))


@query("corr_diagnostics", f"""WITH {BARS}, {ONE}, {_pairs('true')}, m AS (
  SELECT symbol1, symbol2, count(x) AS n, coalesce(avg(x), 0) AS mean_x, coalesce(avg(y), 0) AS mean_y, coalesce(var_pop(x), 0) AS var_x, coalesce(var_pop(y), 0) AS var_y, coalesce(covar_pop(x, y), 0) AS covar
  FROM every LEFT JOIN p USING (symbol1, symbol2) GROUP BY 1, 2)
SELECT symbol1, symbol2, n, {', '.join(f"{r(c)} AS {c}" for c in ('mean_x', 'mean_y', 'var_x', 'var_y', 'covar'))}, {r('sqrt(var_x * var_y)')} AS denominator,
  {r('CASE WHEN n > 1 AND var_x * var_y > 0 THEN covar / sqrt(var_x * var_y) ELSE 0 END')} AS correlation, true AS valid FROM m""")
def corr_diagnostics(spark, sf):
    return with_rounded(correlation.diagnostics(B.measure(B.between(hourly(spark, sf), "2024-01-24 00:00:00", AS_OF), "price")))


COINT = f"""good AS (SELECT symbol FROM filled GROUP BY 1 HAVING min(close) > 0),
l AS (SELECT symbol, start_time, ln(close) AS p FROM filled WHERE symbol IN (SELECT symbol FROM good)),
d AS (SELECT symbol, start_time, p - avg(p) OVER (PARTITION BY symbol) AS c, avg(p) OVER (PARTITION BY symbol) AS m FROM l),
j AS (SELECT a.symbol AS symbol1, b.symbol AS symbol2, start_time, a.c AS x, b.c AS y, a.m AS mx, b.m AS my FROM d a JOIN d b USING (start_time) WHERE a.symbol < b.symbol),
h AS (SELECT symbol1, symbol2, any_value(mx) AS mx, any_value(my) AS my, CASE WHEN var_pop(x) > 1e-12 THEN covar_pop(x, y) / var_pop(x) ELSE 0 END AS beta FROM j GROUP BY 1, 2 HAVING count(*) >= 10),
e AS (SELECT j.symbol1, j.symbol2, start_time, y - beta * x AS e FROM j JOIN h USING (symbol1, symbol2)),
g AS (SELECT *, lag(e) OVER (PARTITION BY symbol1, symbol2 ORDER BY start_time) AS l FROM e),
s AS (SELECT symbol1, symbol2, avg(e) AS mean, stddev_pop(e) AS std, last(e ORDER BY start_time) AS e_last, avg(l) AS ml, avg(CASE WHEN l IS NOT NULL THEN e - l END) AS md,
  count(l) AS n, var_pop(l) AS vl, covar_pop(e - l, l) AS cov FROM g GROUP BY 1, 2),
b AS (SELECT *, CASE WHEN vl > 1e-12 THEN cov / vl ELSE 0 END AS b FROM s),
q AS (SELECT g.symbol1, g.symbol2, sum(power((e - l - md) - b * (l - ml), 2)) AS sse FROM g JOIN b USING (symbol1, symbol2) WHERE l IS NOT NULL GROUP BY 1, 2),
t AS (SELECT *, CASE WHEN vl * n > 1e-12 THEN sqrt(sse / (n - 2) / (vl * n)) ELSE 0 END AS se FROM b JOIN q USING (symbol1, symbol2)),
scan AS (SELECT symbol1, symbol2, beta AS hedge_ratio, my - beta * mx AS intercept, mean AS spread_mean, std AS spread_std, CASE WHEN std > 1e-12 THEN (e_last - mean) / std ELSE 0 END AS spread_z,
  CASE WHEN 1 + b > 0 AND 1 + b < 1 THEN -ln(2) / ln(1 + b) END AS half_life, CASE WHEN se > 1e-12 THEN b / se ELSE 0 END AS adf_t FROM t JOIN h USING (symbol1, symbol2))"""


@query("coint_scan", f"WITH {BARS}, {GRID}, {FILLED}, {COINT} SELECT symbol1, symbol2, {', '.join(f'{r(c)} AS {c}' for c in cointegration.OUT)} FROM scan")
def coint_scan(spark, sf):
    return with_rounded(cointegration.scan(hourly(spark, sf), START, AS_OF))


def _live(sort: str, order: str) -> None:
    digits = {"spread_z": 3, "half_life": 2, "adf_t": 3, "hedge_ratio": 6, "intercept": 6, "spread_std": 6}
    sql = f"""WITH {BARS}, {GRID}, {FILLED}, {COINT} SELECT symbol1 || '-' || symbol2 AS pair, {', '.join(f'{r(c, d)} AS {c}' for c, d in digits.items())}, TIMESTAMP '{AS_OF}' AS calculated_at
FROM scan ORDER BY {order}, symbol1, symbol2 LIMIT 5 OFFSET 1"""

    @query(f"coint_live_table_{sort}", sql)
    def live(spark, sf):
        found = cointegration.scan(hourly(spark, sf), START, AS_OF).withColumn("calculated_at", F.lit(AS_OF).cast("timestamp_ntz"))
        # A plain name in ORDER BY is the rounded column of the page: pairs that read alike are ties, by name. abs(spread_z) isn't rounded.
        found = found.withColumn(sort, rounded(F.col(sort), digits[sort])) if sort in digits else found
        return cointegration.live_table(found, sort, limit=5, offset=1)


for _sort, _order in (("updated", "calculated_at DESC NULLS FIRST"), ("abs_z", "abs(spread_z) DESC NULLS FIRST"), ("half_life", "half_life ASC NULLS LAST"), ("adf_t", "adf_t ASC NULLS LAST")):
    _live(_sort, _order)


def _z(n: str, mean: str, var: str, current: str) -> str:
    return f"CASE WHEN {n} >= 2 AND {var} > 1e-9 THEN ({current} - {mean}) / sqrt({var}) ELSE 0 END"


SNAP = f"""w AS (SELECT unnest([24, 72]) AS hours),
snap AS (SELECT symbol, measure, hours, count(value) AS n, avg(value) AS mean, var_pop(value) AS var, last(value ORDER BY start_time) AS current
  FROM long JOIN w ON start_time >= TIMESTAMP '{AS_OF}' - to_hours(w.hours) AND start_time < TIMESTAMP '{AS_OF}' GROUP BY 1, 2, 3)"""


@query("zscore_snapshot", f"WITH {BARS}, {LONG}, {SNAP} SELECT symbol, measure, hours, n, {r('mean')} AS mean, {r('sqrt(var)')} AS std, {r('current')} AS current, {r(_z('n', 'mean', 'var', 'current'))} AS z FROM snap")
def zscore_snapshot(spark, sf):
    return with_rounded(zscore.snapshot(B.unpivot(hourly(spark, sf)), AS_OF, [24, 72]))


@query("zscore_rolling_24h", f"""WITH {BARS}, {GRID}, m AS (SELECT symbol, start_time, close AS value, count(close) OVER w AS n, avg(close) OVER w AS mean, var_pop(close) OVER w AS var, last_value(close IGNORE NULLS) OVER w AS current
  FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))
SELECT symbol, start_time, {r('value')} AS value, n, {r(f"coalesce({_z('n', 'mean', 'var', 'current')}, 0)")} AS z FROM m""")
def zscore_rolling_24h(spark, sf):
    return with_rounded(zscore.rolling(B.measure(gridded(spark, sf), "price"), 24))


@query("zscore_rolling_stored", SQL["zscore_rolling_24h"])
def zscore_rolling_stored(spark, sf):
    """Candles stored by day and symbol; the frames read them back without an exchange."""
    name = f"candles_{uuid.uuid4().hex}"
    layout.store(gridded(spark, sf), name, f"{work(spark, 'layout')}/candles", buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    return with_rounded(zscore.rolling(B.measure(layout.stored(spark, name), "price"), 24))


@query("zscore_rolling_compat", f"""WITH RECURSIVE {BARS}, {GRID}, g AS (
  SELECT symbol, start_time, close AS v, lag(close, 24) OVER w AS old, row_number() OVER w AS t FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY start_time)),
f AS (
  SELECT symbol, start_time, t, CASE WHEN v IS NULL THEN 0 ELSE 1 END AS n, coalesce(v, 0) AS mean, 0e0 AS m2, v AS current FROM g WHERE t = 1
  UNION ALL
  SELECT g.symbol, g.start_time, g.t, CASE WHEN g.v IS NULL OR (g.old IS NOT NULL AND f.n > 0) THEN f.n ELSE f.n + 1 END,
    CASE WHEN g.v IS NULL THEN f.mean WHEN g.old IS NOT NULL AND f.n > 0 THEN f.mean + (g.v - g.old) / f.n ELSE f.mean + (g.v - f.mean) / (f.n + 1) END,
    CASE WHEN g.v IS NULL THEN f.m2 WHEN g.old IS NOT NULL AND f.n > 0 THEN f.m2 + (g.v - g.old) * (g.v - (f.mean + (g.v - g.old) / f.n) + g.old - f.mean)
      ELSE f.m2 + (g.v - f.mean) * (g.v - (f.mean + (g.v - f.mean) / (f.n + 1))) END,
    coalesce(g.v, f.current)
  FROM f JOIN g ON g.symbol = f.symbol AND g.t = f.t + 1)
SELECT symbol, start_time, CAST(n AS BIGINT) AS n, {r('CASE WHEN n >= 2 AND m2 / n > 1e-9 THEN (current - mean) / sqrt(m2 / n) ELSE 0 END')} AS z FROM f""")
def zscore_rolling_compat(spark, sf):
    return with_rounded(zscore.rolling_compat(B.measure(gridded(spark, sf), "price"), 24))


@query("zscore_integrity", f"""WITH {BARS}, {GRID}, m AS (SELECT symbol, close, lag(close, 24) OVER (PARTITION BY symbol ORDER BY start_time) AS old FROM grid)
SELECT symbol, count(*) FILTER (close IS NULL) AS missing_new, count(*) FILTER (close IS NOT NULL AND old IS NULL) AS added_without_old, count(*) FILTER (close IS NOT NULL AND old IS NOT NULL) AS updated_with_old FROM m GROUP BY 1""")
def zscore_integrity(spark, sf):
    return zscore.integrity(B.measure(gridded(spark, sf), "price"), 24)


@query("zscore_matrix", f"""WITH {BARS}, {LONG}, {SNAP}, z AS (SELECT symbol, measure, {r(_z('n', 'mean', 'var', 'current'), 3)} AS z FROM snap WHERE hours = 24)
SELECT symbol, max(z) FILTER (measure = 'price') AS x, max(z) FILTER (measure = 'volume') AS y, max(z) FILTER (measure = 'trades') AS size FROM z WHERE symbol IN ('view', 'click', 'error') GROUP BY 1""")
def zscore_matrix(spark, sf):
    points = zscore.matrix(zscore.snapshot(B.unpivot(hourly(spark, sf)), AS_OF, [24, 72]), 24, "price", "volume", "trades", ["view", "click", "nobody", "error"])
    return points.select("symbol", *[F.element_at("point", i + 1).alias(c) for i, c in enumerate(("x", "y", "size"))])


@query("zscore_heatmap", f"""WITH {BARS}, {GRID}, m AS (SELECT symbol, start_time, close, count(close) OVER w AS n, avg(close) OVER w AS mean, var_pop(close) OVER w AS var, last_value(close IGNORE NULLS) OVER w AS current
  FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
h AS (SELECT symbol, start_time, coalesce({_z('n', 'mean', 'var', 'current')}, 0) AS z FROM m WHERE close IS NOT NULL AND start_time >= TIMESTAMP '2024-01-30 12:00:00'),
a AS (SELECT start_time, row_number() OVER (ORDER BY start_time) - 1 AS x FROM (SELECT DISTINCT start_time FROM h WHERE symbol IN ('view', 'error'))),
s AS (SELECT * FROM (VALUES (0, 'view'), (1, 'error')) v(y, symbol))
SELECT CAST(s.y AS INTEGER) AS y, CAST(a.x AS INTEGER) AS x, strftime(a.start_time, '%H:%M') AS time, s.symbol, {r('h.z', 3)} AS value FROM a CROSS JOIN s LEFT JOIN h ON h.symbol = s.symbol AND h.start_time = a.start_time""")
def zscore_heatmap(spark, sf):
    rolled = zscore.rolling(B.measure(gridded(spark, sf), "price"), 24).where("value is not null and start_time >= timestamp_ntz'2024-01-30 12:00:00'")
    history = rolled.select("symbol", F.col("z").alias("price"), F.lit(24).alias("hours"), F.col("start_time").alias("calculated_at"))
    return zscore.heatmap(history, "price", 24, ["view", "error"])


@query("corr_drift", f"""WITH {BARS}, {ONE}, {_pairs('true')}, f AS (SELECT symbol1, symbol2, {PEARSON} AS c, coalesce(corr(x, y), 0) AS independent FROM p GROUP BY 1, 2 HAVING count(*) > 1)
SELECT symbol1, symbol2, {r('c')} AS correlation, {r('independent')} AS independent, abs(c - independent) > 0.2 OR abs(c) > 1.000001 AS drifted FROM f""")
def corr_drift(spark, sf):
    """The matrix from products of blocks held against Spark's own moments over a join."""
    price = B.measure(hourly(spark, sf), "price")
    found = correlation.drift(correlation.matrix(price, AS_OF, [168]), price, AS_OF, 168)
    return with_rounded(found.drop("difference"))


@query("zscore_history_rows", f"""WITH {BARS}, {LONG}, {SNAP}, z AS (SELECT symbol, hours, measure, {_z('n', 'mean', 'var', 'current')} AS z FROM snap)
SELECT symbol, hours, {', '.join(f"{r(f'coalesce(max(z) FILTER (measure = {chr(39)}{m}{chr(39)}), 0)')} AS {m}" for m in ('price', 'volume', 'trades'))}, TIMESTAMP '{AS_OF}' AS calculated_at
FROM z WHERE symbol <> 'signup' GROUP BY 1, 2""")
def zscore_history_rows(spark, sf):
    """Symbols that the dimension lacks (here one) have no history."""
    known = hourly(spark, sf).select("symbol").distinct().where("symbol <> 'signup'")
    return with_rounded(zscore.history_rows(zscore.snapshot(B.unpivot(hourly(spark, sf)), AS_OF, [24, 72]), AS_OF, known))


@query("zscore_drift", f"""WITH {BARS}, {GRID}, m AS (SELECT symbol, start_time, count(close) OVER w AS n, avg(close) OVER w AS mean, var_pop(close) OVER w AS var, last_value(close IGNORE NULLS) OVER w AS current
  FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY start_time ROWS BETWEEN 71 PRECEDING AND CURRENT ROW)),
s AS (SELECT symbol, count(close) AS n, avg(close) AS mean, var_pop(close) AS var, arg_max(close, start_time) AS current FROM bars
  WHERE start_time >= TIMESTAMP '{AS_OF}' - INTERVAL 72 HOUR AND start_time < TIMESTAMP '{AS_OF}' GROUP BY 1),
z AS (SELECT m.symbol, {_z('m.n', 'm.mean', 'm.var', 'm.current')} AS z, {_z('s.n', 's.mean', 's.var', 's.current')} AS independent FROM m JOIN s USING (symbol)
  WHERE m.start_time = TIMESTAMP '{AS_OF}' - INTERVAL 1 HOUR)
SELECT symbol, {r('z')} AS z, {r('independent')} AS independent, abs(z - independent) > 0.25 AS drifted, abs(z) <= 50 AS valid FROM z""")
def zscore_drift(spark, sf):
    """The rolling frame's last step held against the snapshot."""
    found = zscore.drift(zscore.rolling(B.measure(gridded(spark, sf), "price"), 72), B.unpivot(hourly(spark, sf)), AS_OF, 72)
    return with_rounded(found)


# The same operators over a table of two markets: each stands alone.
MARKETS = ["binance", "okx"]


def by_market(sql: str) -> str:
    """``sql`` over the ticks of each market, one after the other."""
    parts = [f"SELECT '{m}' AS exchange, * FROM ({sql.replace('FROM events', f'FROM (SELECT * FROM events WHERE user_id % 2 = {k}) events')})" for k, m in enumerate(MARKETS)]
    return " UNION ALL ".join(parts)


def market_events(spark: SparkSession, sf: str) -> DataFrame:
    """The ticks as those of two exchanges, by user."""
    events = table(spark, sf, "events")
    return events.withColumn("exchange", F.when(F.col("user_id") % 2 == 0, MARKETS[0]).otherwise(MARKETS[1]))


def _market(name: str, operator) -> None:
    query(f"market_{name}", by_market(SQL[name]))(lambda spark, sf: operator(market_events(spark, sf)))


_hours = lambda e: B.bars(e)
_grid = lambda e: B.on_grid(B.bars(e), START, AS_OF)
_market("bars_hourly", lambda e: with_rounded(_hours(e)))
_market("seasonality_dow", lambda e: seasonality.seasonality(_hours(e), "day", AS_OF, ALL_HOURS, DIGITS))
_market("grid_filled", lambda e: B.filled(_grid(e).select("exchange", "symbol", "start_time", "close"), ["close"]))
_market("corr_matrix", lambda e: with_rounded(correlation.matrix(B.unpivot(_hours(e)), AS_OF, WINDOWS, ["measure"])))
_market("corr_rolling_24h", lambda e: with_rounded(correlation.rolling(B.measure(_grid(e), "price"), 24)))
_market("coint_scan", lambda e: with_rounded(cointegration.scan(_hours(e), START, AS_OF)))
_market("zscore_snapshot", lambda e: with_rounded(zscore.snapshot(B.unpivot(_hours(e)), AS_OF, [24, 72])))
_market("zscore_rolling_24h", lambda e: with_rounded(zscore.rolling(B.measure(_grid(e), "price"), 24)))
