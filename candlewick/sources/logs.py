"""Landed logs whose entries have a position ``ms-seq``, and a stream over them that starts after any position.

``append_log`` lands entries as Parquet files, each a range of positions, with the position's parts as the columns ``ms`` and
``seq``; so the footers of the files say which positions they have. ``LandedLog`` is the stream's source: its offset is the
position of the last entry that was read. A batch goes from the last offset to the newest position that has landed, in
partitions of about ``count`` entries (at least a row group), and its checkpoint goes on where it ended. Files don't change once
they are there, so the driver reads each footer and last position once; entries are read by the tasks alone.

Positions only grow: an entry that lands with a position before an offset that was passed is not seen by that stream, as in
any log. Folders that pyarrow can open (local and shared ones, HDFS, S3 and GCS) can be read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..functions.scalar import stream_position

#: Entries of a partition.
COUNT = 100_000
BEGIN = (-1, -1)
Position = tuple[int, int]


def position(text: str | None) -> Position:
    """``ms-seq`` or ``ms`` as numbers; None is before all entries."""
    if not text:
        return BEGIN
    ms, _, seq = text.partition("-")
    return int(ms), int(seq or 0)


def append_log(rows: DataFrame, path: str, id_col: str = "id", count: int = COUNT) -> None:
    """Lands ``rows`` with the parts of their position, in files of ``count`` that are ranges of it. Rows without one are refused.

    Each append is a folder that readers take once it is whole, so they don't see a later range before an earlier one.
    """
    at = stream_position(F.col(id_col))
    ms = F.coalesce(at["ms"], F.raise_error(F.lit(f"{id_col} has no position")).cast("bigint"))
    each = rows.withColumns({"ms": ms, "seq": at["seq"]})
    each.repartitionByRange("ms", "seq").sortWithinPartitions("ms", "seq").write.option("maxRecordsPerFile", count).parquet(f"{path}/append-{uuid.uuid4().hex}")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path:
        path = path.removeprefix("file:")
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(path)


@dataclass
class Groups(InputPartition):
    """Row groups of a file and the positions that count: after ``after``, up to ``upto``."""

    file: str
    groups: list[int]
    after: Position
    upto: Position


class LandedLog(DataSource):
    """``spark.readStream.format("landed_log").schema(..).option("path", ..).option("after", "ms-seq").option("count", n)``."""

    @classmethod
    def name(cls) -> str:
        return "landed_log"

    def schema(self) -> str:
        return "id string, ms bigint, seq bigint"

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(self.options["path"], schema.names, position(self.options.get("after")), int(self.options.get("count", COUNT)))


class LogReader(DataSourceStreamReader):
    def __init__(self, path: str, columns: list[str], after: Position, count: int):
        self.path, self.columns, self.after, self.count = path, columns, after, count
        #: file -> rows of each row group and bounds of its positions.
        self.known: dict[str, list[tuple[int, Position, Position]]] = {}
        #: file -> its last position.
        self.last: dict[str, Position] = {}

    def initialOffset(self) -> dict:
        return dict(zip(("ms", "seq"), self.after))

    def latestOffset(self) -> dict:
        self._look()
        newest = max([self.after, *self.last.values()])
        return dict(zip(("ms", "seq"), newest))

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        self._look()
        after, upto, out = (start["ms"], start["seq"]), (end["ms"], end["seq"]), []
        for file, groups in sorted(self.known.items()):
            mine: list[int] = []
            rows = 0
            for k, (n, lo, hi) in enumerate(groups):
                if hi <= after or lo > upto:
                    continue
                if mine and rows + n > self.count:
                    out.append(Groups(file, mine, after, upto))
                    mine, rows = [], 0
                mine.append(k)
                rows += n
            if mine:
                out.append(Groups(file, mine, after, upto))
        # A batch without partitions is no batch to Spark.
        return out or [Groups("", [], after, upto)]

    def read(self, partition: Groups) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = _open(self.path)
        with fs.open_input_file(partition.file) as source:
            need = list(dict.fromkeys([*self.columns, "ms", "seq"]))
            for batch in pq.ParquetFile(source).iter_batches(min(self.count, 10_000), partition.groups, need):
                yield from self._between(batch, partition).select(self.columns).to_batches()

    def _between(self, batch: pa.RecordBatch, partition: Groups) -> pa.Table:
        ms, seq = batch.column("ms"), batch.column("seq")
        (a, b), (c, d) = partition.after, partition.upto
        later = pc.or_(pc.greater(ms, a), pc.and_(pc.equal(ms, a), pc.greater(seq, b)))
        before = pc.or_(pc.less(ms, c), pc.and_(pc.equal(ms, c), pc.less_equal(seq, d)))
        return pa.Table.from_batches([batch]).filter(pc.and_(later, before))

    def _look(self) -> None:
        """Footers of the files that weren't there before."""
        fs, root = _open(self.path)
        listed = [f.path for f in fs.get_file_info(pafs.FileSelector(root, allow_not_found=True, recursive=True)) if f.is_file]
        whole = {f.rpartition("/")[0] for f in listed if f.endswith("/_SUCCESS")}
        found = {f for f in listed if f.rpartition("/")[0] in whole and f.rpartition("/")[2].startswith("part-")}
        # Files that retention took are no entries any more; what was newest stays an offset.
        self.known = {f: g for f, g in self.known.items() if f in found}
        for file in sorted(found - self.known.keys()):
            with fs.open_input_file(file) as source:
                parquet = pq.ParquetFile(source)
                names = {parquet.metadata.schema.column(i).path: i for i in range(parquet.metadata.num_columns)}
                groups = []
                for k in range(parquet.num_row_groups):
                    g = parquet.metadata.row_group(k)
                    ms, seq = (g.column(names[c]).statistics for c in ("ms", "seq"))
                    # The greatest seq need not go with the greatest ms: bounds may be wide, and rows are held against the offsets.
                    groups.append((g.num_rows, (ms.min, seq.min), (ms.max, seq.max)))
                if groups:
                    # An offset must be exact, else an entry that lands below it would be passed over.
                    end = parquet.read_row_group(parquet.num_row_groups - 1, ["ms", "seq"])
                    self.last[file] = max(zip(end["ms"].to_pylist()[-1:], end["seq"].to_pylist()[-1:]), default=BEGIN)
            self.known[file] = groups


def read_log(spark: SparkSession, path: str, schema: str | StructType, after: str | None = None, count: int = COUNT) -> DataFrame:
    """The log's entries after ``after`` as a stream, all of them for None."""
    spark.dataSource.register(LandedLog)
    rows = spark.readStream.format("landed_log").schema(schema).option("path", path).option("count", count)
    return (rows.option("after", after) if after else rows).load()
