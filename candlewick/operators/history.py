"""History tables: insert-ignore, upsert of the latest, retention, and the history of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAIR_METRICS
from ..functions.scalar import at, hours, partition_hour, perspective
from ..sources.tables import work
from .scope import series as market_series


#: The partition column of histories by hours.
HOUR = "hour_part"


def insert_ignore(existing: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``new`` to append: keys not in ``existing``, of repeated keys the first by ``order``. First writer wins."""
    rest = [c for c in new.columns if c not in keys]
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])
    return first.join(existing.select(*keys), keys, "left_anti").select(*new.columns)


def upsert_latest(existing: DataFrame, new: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key of either side, the one with the greatest ``version``. Last writer wins."""
    rest = [c for c in new.columns if c not in keys]
    both = existing.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)))
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(version, "__new")).alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest]).select(*new.columns)


def with_ids(names: DataFrame, existing: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Get or create: ``existing`` and the new keys, numbered on from the greatest identifier in the keys' order.

    New keys lie in sorted ranges; a range's numbers go on from the counts of the ranges before, a row for each range.
    """
    spark, path = names.sparkSession, work(names.sparkSession, "ids")
    top = existing.agg(F.coalesce(F.max(id_col), F.lit(0)).cast("bigint").alias("top"))
    new = names.select(*key).distinct().join(existing, key, "left_anti")
    # Written, so that ranges and places stay as they are.
    new.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("__at", F.monotonically_increasing_id()).write.parquet(path)
    dealt = spark.read.parquet(path).withColumn("__range", F.shiftright("__at", 33))
    ranges = dealt.groupBy("__range").agg(F.count(F.lit(1)).alias("n"), F.min("__at").alias("first")).crossJoin(top)
    before = F.coalesce(F.sum("n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = ranges.select("__range", (F.col("top") + before - F.col("first") + 1).alias("shift"))
    numbered = dealt.join(shift, "__range").select((F.col("__at") + F.col("shift")).cast("bigint").alias(id_col), *key)
    return existing.select(id_col, *key).unionByName(numbered)


def symbol_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """symbol (of each market), change: ``added`` or ``removed``."""
    keys = market_series(before)
    a, b = before.select(*keys).distinct(), after.select(*keys).distinct()
    return b.join(a, keys, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, keys, "left_anti").withColumn("change", F.lit("removed")))


def same_symbols(before: DataFrame, after: DataFrame) -> bool:
    return symbol_diff(before, after).isEmpty()


def keep_partitions(rows: DataFrame, now: str | Column, retention_hours: int, part: str = HOUR) -> DataFrame:
    """What stays after hour partitions before now - retention - 1 h are dropped.

    ``part`` is the table's partition column (yyyyMMddHH), so folders that go are not read.
    """
    return rows.where(F.col(part) >= F.date_format(at(now) - hours(retention_hours + 1), "yyyyMMddHH"))


def keep_rows_since(rows: DataFrame, now: str | Column, retention_hours: int, time: str = "calculated_at") -> DataFrame:
    return rows.where(F.col(time) >= at(now) - hours(retention_hours))


def canonical(rows: DataFrame) -> DataFrame:
    """Pairs with the lesser name first."""
    return rows.withColumns({"symbol1": F.least("symbol1", "symbol2"), "symbol2": F.greatest("symbol1", "symbol2")})


def pair_history(
    history: DataFrame, base: str, comparisons: list[str], metric: str, since: str | Column, digits: int | None = None, newest_first: bool = False, window: int | None = None, window_col: str = "hours"
) -> DataFrame:
    """place, symbol, time, value of ``base`` with each comparison; a comparison without history has one row of nulls.

    Comparisons come in the order asked for, each once and without ``base``; pairs match either way round. Of a history
    of several windows (the column ``window_col``) only ``window`` counts, by default 1. Of a history stored by hours
    (the column ``hour_part``) the folders before ``since`` aren't read.
    """
    digits = PAIR_METRICS.get(metric, 3) if digits is None else digits
    asked = [s for s in dict.fromkeys(comparisons) if s != base]
    names = history.sparkSession.createDataFrame([(i, s) for i, s in enumerate(asked)], "place bigint, symbol string")
    if window_col in history.columns:
        history = history.where(F.col(window_col) == (1 if window is None else window))
    mine = history.where(((F.col("symbol1") == base) & F.col("symbol2").isin(asked)) | ((F.col("symbol2") == base) & F.col("symbol1").isin(asked)))
    mine = mine.where(F.col("calculated_at") >= at(since))
    if HOUR in history.columns:
        mine = mine.where(F.col(HOUR).cast("bigint") >= partition_hour(at(since)).cast("bigint"))
    mine = mine.select(perspective(F.lit(base), F.col("symbol1"), F.col("symbol2")).alias("symbol"), F.col("calculated_at").alias("time"), (F.round(metric, digits) + F.lit(0.0)).alias("value"))
    out = names.join(mine, "symbol", "left").select("place", "symbol", "time", "value")
    return out.orderBy("place", F.col("time").desc_nulls_last() if newest_first else F.col("time").asc_nulls_last())


def coint_history(history: DataFrame, base: str, comparisons: list[str], metric: str, since: str | Column, window_minutes: int) -> DataFrame:
    """``pair_history`` of a cointegration metric and window, oldest first; an unknown metric is an error."""
    if metric not in PAIR_METRICS:
        raise ValueError(f"metric must be one of {sorted(PAIR_METRICS)}, not {metric!r}")
    return pair_history(history, base, comparisons, metric, since, window=window_minutes, window_col="window_minutes")


def series(pairs: DataFrame) -> DataFrame:
    """place, symbol, points: each comparison's history as one list of time and value, in time order."""
    point = F.when(F.col("time").isNotNull(), F.struct("time", "value"))
    return pairs.groupBy("place", "symbol").agg(F.array_sort(F.collect_list(point)).alias("points"))
