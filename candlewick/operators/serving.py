"""Results in the shapes that clients get: JSON rows, the start-up configuration, correlation lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import config
from ..functions.scalar import ISO
from .ranking import defaults


def to_json(rows: DataFrame, name: str = "body") -> DataFrame:
    """Each row as one JSON object."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias(name))


def history_points(pairs: DataFrame, newest_first: bool = True) -> DataFrame:
    """symbol, points: [iso time, value] of each comparison (place, symbol, time, value)."""
    point = F.when(F.col("time").isNotNull(), F.struct("time", "value"))
    listed = F.sort_array(F.collect_list(point), asc=not newest_first)
    iso = F.transform(listed, lambda p: F.array(F.date_format(p["time"], ISO), p["value"].cast("string")))
    return pairs.groupBy("place", "symbol").agg(iso.alias("points")).orderBy("place").drop("place")


def bootstrap(spark: SparkSession, symbols: DataFrame, ranked: DataFrame) -> DataFrame:
    """exchange, name, data_types, hours_options, symbols, chart_defaults, live_table of each active exchange.

    A chart has symbols, and those of pairs the base_symbol that the symbols are compared with; of cointegration also a window.

    ``symbols`` has exchange and symbol, ``ranked`` exchange, symbol and rank; an exchange without any has empty lists.
    ``hours_options`` are written as text, as clients get them.
    """
    hours = {"correlation": config.CORRELATION_HOURS, "correlation_pair": config.CORRELATION_PAIR_HOURS, "cointegration_pair": config.COINTEGRATION_PAIR_HOURS, "zscore": config.ZSCORE_HOURS}
    rows, active = [], {k: e for k, e in config.EXCHANGES.items() if e["active"]}
    for k, e in active.items():
        options = hours | {"average_price": {w: config.AVERAGE_PRICE_HOURS[w] for w in e["average_price"]}}
        rows.append((k, e["name"], e["data_types"], {c: {w: str(n) for w, n in o.items()} for c, o in options.items()}))
    conf = spark.createDataFrame(rows, "exchange string, name string, data_types array<string>, hours_options map<string,map<string,string>>")
    none = F.array().cast("array<string>")
    listed = symbols.groupBy("exchange").agg(F.array_sort(F.collect_set("symbol")).alias("symbols"))
    primary = F.element_at(F.create_map(*[x for k, e in active.items() for x in (F.lit(k), F.lit(e["primary_symbol"]))]), F.col("exchange"))
    found = defaults(ranked.select("exchange", "symbol", "rank"), primary)
    charts = found.groupBy("exchange").agg(F.map_from_entries(F.collect_list(F.struct("use", "symbols"))).alias("found"))
    window = str(next(iter(config.LIVE_WINDOWS.values())))

    def chart(use: str) -> Column:
        pairs, text = use in config.PAIR_CHARTS, F.lit(None).cast("string")
        own = F.coalesce(F.try_element_at("found", F.lit(use)), none) if use != "price_change_percentage" else F.array(primary)
        return F.struct(own.alias("symbols"), (primary if pairs else text).alias("base_symbol"), (F.lit(window) if config.PAIR_CHARTS.get(use) else text).alias("window"))

    uses = [*(use for use, *_ in config.CHART_DEFAULTS), "price_change_percentage"]
    all_charts = F.create_map(*[x for use in uses for x in (F.lit(use), chart(use))])
    windows = F.create_map(*[x for k, n in config.LIVE_WINDOWS.items() for x in (F.lit(k), F.lit(str(n)))])
    live = F.struct(windows.alias("window_options"), F.array(*[F.lit(n) for n in config.LIVE_LIMITS]).alias("limit_options"), F.array(*[F.lit(k) for k in config.LIVE_SORTS]).alias("sort_keys"))
    out = conf.join(listed, "exchange", "left").join(charts, "exchange", "left")
    return out.select("exchange", "name", "data_types", "hours_options", F.coalesce("symbols", none).alias("symbols"), all_charts.alias("chart_defaults"), live.alias("live_table"))
