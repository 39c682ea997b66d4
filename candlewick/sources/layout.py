"""Candles and histories stored by market and day, bucketed by symbol: ranges of time read their days alone, and windows,
latest rows and as-of reads by symbol find each symbol in one task already, so they need no exchange.

A table is external: its files are at ``path``, its layout is in the session's catalog. A day's bucket is one file of an
append, written by a task of its own, so a symbol that holds much of the table is written in parts, a day each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import at
from ..operators.scope import scope

#: Buckets of a day: as many as the tasks that read a range by symbol.
BUCKETS = 64
DAY = "day"


def store(rows: DataFrame, name: str, path: str, time: str = "start_time", buckets: int = BUCKETS) -> None:
    """Appends ``rows`` (symbol, ``time`` and perhaps a market) to the table; null times have a day of their own."""
    each = rows.withColumn(DAY, F.col(time).cast("date"))
    parts = [*scope(rows), DAY]
    # The bucket as the writer has it, so that a day's bucket comes from one task.
    dealt = each.repartition(*parts, F.pmod(F.hash("symbol"), F.lit(buckets)))
    dealt.write.mode("append").format("parquet").partitionBy(*parts).bucketBy(buckets, "symbol").sortBy("symbol", time).option("path", path).saveAsTable(name)


def stored(spark: SparkSession, name: str, since: str | Column | None = None, before: str | Column | None = None, time: str = "start_time") -> DataFrame:
    """The table's rows from ``since`` to before ``before``; of other days nothing is read."""
    rows = spark.table(name)
    if since is not None:
        rows = rows.where((F.col(DAY) >= at(since).cast("date")) & (F.col(time) >= at(since)))
    if before is not None:
        rows = rows.where((F.col(DAY) <= at(before).cast("date")) & (F.col(time) < at(before)))
    return rows.drop(DAY)
