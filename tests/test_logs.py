"""The stream over a landed log: from its start, from a position, and from its checkpoint."""

from __future__ import annotations

import pytest

from candlewick.sources.logs import LogReader, append_log, position, read_log
from candlewick.streaming.queries import land

SCHEMA = "id string, symbol string, value double"


def _entries(spark, ids):
    return spark.createDataFrame([(i, f"s{k % 3}", float(k)) for k, i in enumerate(ids)], SCHEMA)


def _ids(rows):
    return sorted((r.id for r in rows.collect()), key=position)


def test_a_log_is_read_from_its_start_a_position_and_its_checkpoint(spark, tmp_path):
    log, first = str(tmp_path / "log"), [f"{1000 + k // 4}-{k % 4}" for k in range(400)]
    append_log(_entries(spark, first), log, count=50)
    run = lambda name, after=None: land(read_log(spark, log, SCHEMA, after, 100), str(tmp_path / name))
    assert _ids(run("all")) == first
    # A position inside a millisecond, inside a file.
    assert _ids(run("middle", "1050-1")) == [i for i in first if position(i) > (1050, 1)]
    assert _ids(run("whole", "1050")) == [i for i in first if position(i) > (1050, 0)]
    assert _ids(run("end", "1099-3")) == []
    # The last millisecond goes on below the greatest seq of other ones; each run takes what is new.
    more = [f"1099-{k}" for k in range(4, 9)] + ["1100-0", "1100-1"]
    append_log(_entries(spark, more[:6]), log)
    assert _ids(run("all")) == first + more[:6]
    append_log(_entries(spark, more[6:]), log)
    assert _ids(run("all")) == first + more
    assert _ids(run("middle", "1050-1")) == [i for i in first + more if position(i) > (1050, 1)]
    assert _ids(run("end", "1099-3")) == more


def test_a_log_is_planned_in_ranges(spark, tmp_path):
    log = str(tmp_path / "log")
    append_log(_entries(spark, [f"{k}-0" for k in range(1000)]).coalesce(1), log, count=100)
    reader = LogReader(log, ["id"], (-1, -1), 100)
    start, end = reader.initialOffset(), reader.latestOffset()
    assert end == {"ms": 999, "seq": 0}
    parts = reader.partitions(start, end)
    assert len(parts) >= 10
    found = [[i for b in reader.read(p) for i in b.column("id").to_pylist()] for p in parts]
    assert sum(found, []) and max(map(len, found)) <= 100 and sorted(map(position, sum(found, []))) == [(k, 0) for k in range(1000)]
    # Of a later start only the files that reach over it are read.
    assert len(reader.partitions({"ms": 950, "seq": 0}, end)) <= 2
    assert [p.file for p in reader.partitions(end, end)] == [""]


def test_an_empty_or_absent_log_and_rows_without_a_position(spark, tmp_path):
    assert LogReader(str(tmp_path / "none"), ["id"], (5, 0), 10).latestOffset() == {"ms": 5, "seq": 0}
    append_log(_entries(spark, []), str(tmp_path / "empty"))
    assert land(read_log(spark, str(tmp_path / "empty"), SCHEMA), str(tmp_path / "w")).count() == 0
    with pytest.raises(Exception, match="has no position"):
        append_log(_entries(spark, ["1-0", None]), str(tmp_path / "bad"))
