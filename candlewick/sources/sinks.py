"""Writers: partitioned appends, insert-ignore, versioned snapshots and latest tables, retention.

A table is never read and overwritten at one path: each new version of a snapshot goes to a folder of its own, and
readers take the last one that is whole.
"""

from __future__ import annotations

import datetime as dt
import re
import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import RETENTION_HOURS
from ..functions.scalar import partition_hour
from ..operators.history import HOUR, insert_ignore, upsert_latest
from ..operators.scope import series
from ..operators.zscore import heatmap, history_rows

#: Files of an hour in one append.
WRITERS = 4


def append_by_hour(rows: DataFrame, path: str, time_col: str = "calculated_at", writers: int = WRITERS) -> None:
    """Appends with a folder for each hour; the hour and a salt deal the rows out, so an hour has ``writers`` files at most."""
    part = rows.withColumn(HOUR, partition_hour(F.col(time_col)))
    salt = F.pmod(F.xxhash64(*rows.columns), F.lit(writers))
    part.repartition(F.col(HOUR), salt).write.mode("append").partitionBy(HOUR).parquet(path)


def append_new(rows: DataFrame, path: str, keys: list[str], order: list[str], time_col: str | None = None) -> DataFrame:
    """Insert-ignore into the Parquet table at ``path``; returns what was appended.

    Where one of the keys is a time, ``time_col``, only the stored rows between the new rows' least and greatest time are
    read: the bounds go down to the files' statistics. Stored rows without a time meet no new row, as null equals no key.
    The new rows go to a folder beside the table and are moved in whole, so they are worked out and written once.
    """
    spark = rows.sparkSession
    before = spark.read.schema(rows.schema).parquet(path) if _exists(spark, path) else rows.limit(0)
    if time_col:
        # Two values.
        least, greatest = rows.agg(F.min(time_col).cast("string"), F.max(time_col).cast("string")).first()
        kind = rows.schema[time_col].dataType
        before = before.where(F.col(time_col).between(F.lit(least).cast(kind), F.lit(greatest).cast(kind)))
    new = insert_ignore(before, rows, keys, order)
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    new.write.parquet(stage)
    p, fs = _path(spark, path)
    fs.mkdirs(p)
    moved = []
    for f in fs.listStatus(_path(spark, stage)[0]):
        if f.getPath().getName().startswith("part-"):
            to = spark._jvm.org.apache.hadoop.fs.Path(p, f.getPath().getName())
            fs.rename(f.getPath(), to)
            moved.append(to.toString())
    fs.delete(_path(spark, stage)[0], True)
    return spark.read.schema(rows.schema).parquet(*moved) if moved else spark.createDataFrame([], rows.schema)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def _exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def write_snapshot(rows: DataFrame, path: str) -> str:
    """A new version of the snapshot at ``path``; readers see it once it is whole."""
    version = f"{path}/v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    rows.write.parquet(version)
    return version


def read_snapshot(spark: SparkSession, path: str) -> DataFrame | None:
    """The last whole version, or None before the first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return None
    whole = sorted(s.getPath().toString() for s in fs.listStatus(p) if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS")))
    return spark.read.parquet(whole[-1]) if whole else None


def save_history_and_latest(rows: DataFrame, history: str, latest: str, keys: list[str], version: str = "calculated_at") -> None:
    """Appends to the history and puts the rows into the latest table, by last writer.

    ``rows`` are worked out once, for a snapshot beside the latest table; if a run ends between the two writes, the next
    one's latest table is still right, as it takes the greatest version.
    """
    spark = rows.sparkSession
    rows = spark.read.schema(rows.schema).parquet(write_snapshot(rows, f"{latest}.new"))
    append_by_hour(rows, history, version)
    before = read_snapshot(spark, latest)
    write_snapshot(upsert_latest(before if before is not None else rows.limit(0), rows, keys, version), latest)


def save_zscores(scores: DataFrame, calculated_at: str, history: str, snapshots: str, symbols: DataFrame | None = None, store: bool = True) -> None:
    """A snapshot of all windows' z-scores, and their history, to which a symbol, window and time are added once.

    With ``store`` off only the snapshot is written, as for backfilled minutes.
    """
    write_snapshot(scores, snapshots)
    if store:
        rows = history_rows(scores, calculated_at, symbols)
        append_new(rows, history, [*series(rows), "hours", "calculated_at"], ["price"], "calculated_at")


def save_heatmap(history: DataFrame, measure: str, hours: int, symbols: list[str], snapshots: str) -> None:
    """A snapshot of one heat map's cells."""
    write_snapshot(heatmap(history, measure, hours, symbols), f"{snapshots}/{measure}-{hours}")


def drop_old_hours(spark: SparkSession, path: str, before_hour: str) -> list[str]:
    """Deletes the hour folders before ``before_hour`` (yyyyMMddHH) of a table by hours; returns their names."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    old = sorted(n for n in names if re.fullmatch(rf"{HOUR}=[0-9]{{10}}", n) and n.split("=")[1] < before_hour)
    for n in old:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(p, n), True)
    return old


def retain(spark: SparkSession, path: str, kind: str, now: dt.datetime) -> list[str]:
    """Deletes the hours of a history of this kind (correlation, cointegration, zscore) that are past its retention."""
    return drop_old_hours(spark, path, (now - dt.timedelta(hours=RETENTION_HOURS[kind] + 1)).strftime("%Y%m%d%H"))
