"""Stateful operators: rolling correlation kept up step by step, minutes forced by a newer one, times published once.

``RollingCorrelation`` is the state of two blocks of symbols within a market and measure: a map from step to the values of
that step, and for each window the sums that all correlations follow from. A new step adds one outer product to each
window's sums and takes away those of the steps that leave it, as they were added; so the cost of a batch is that of its
steps, whatever the windows' length. Values are taken from a shift of their symbol, so that the sums keep their digits,
and every ``rebuild`` steps the sums are made anew from the map, with the means as shifts. How far the correlations move then
is the state's drift: it goes along with the rows, and a ``DriftListener`` hears of it.

A symbol's value at a step counts once, the first one that came. So rows that stand in the history and in the stream count
once, a symbol that is added later is filled in by its history (rows of any step that a window still holds), and the order
of rows doesn't matter beyond which came first. A row of source ``removed`` ends a symbol: its row and column of the sums
go, and what the map still holds of it counts no more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.scalar import stream_position
from ..operators.blocks import BLOCK_SYMBOLS
from ..operators.scope import scope
from .queries import Stepped

#: Steps after which the sums are made anew, and published times that are remembered.
REBUILD, RECENT = 1440, 500
#: A correlation that was off by more has drifted.
DRIFT_TOLERANCE = 0.2
PAIR = np.dtype([("id", "<i4"), ("v", "<f8")])


class Sums:
    """Counts, sums, sums of squares and products of all pairs of symbols for each window, in a growing array."""

    def __init__(self, windows: list[int], names: list[str], own: list[int], ids: list[int], shift: np.ndarray, sums: np.ndarray, newest: int | None, since: int, next_id: int):
        self.windows, self.names, self.own, self.ids, self.shift, self.sums = windows, names, own, ids, shift, sums
        self.newest, self.since, self.next_id = newest, since, next_id
        #: How far the sums were off when they were last made anew in this batch.
        self.drift: float | None = None

    @classmethod
    def empty(cls, windows: list[int]) -> Sums:
        return cls(windows, [], [], [], np.zeros(0), np.zeros((len(windows), 4, 0, 0)), None, 0, 0)

    @classmethod
    def load(cls, windows: list[int], row: tuple | None) -> Sums:
        if row is None:
            return cls.empty(windows)
        names, own, ids, shift, sums, newest, since, next_id = row
        n = len(names)
        return cls(windows, list(names), list(own), list(ids), np.frombuffer(shift).copy(), np.frombuffer(sums).reshape(len(windows), 4, n, n).copy(), newest, since, next_id)

    def row(self) -> tuple:
        return self.names, self.own, self.ids, self.shift.tobytes(), self.sums.tobytes(), self.newest, self.since, self.next_id

    def place(self, name: str, own: int, value: float) -> int:
        """The place of a symbol, a new one at the end."""
        if name in self.names:
            return self.names.index(name)
        self.names.append(name)
        self.own.append(own)
        self.ids.append(self.next_id)
        self.next_id += 1
        self.shift = np.append(self.shift, value)
        self.sums = np.pad(self.sums, ((0, 0), (0, 0), (0, 1), (0, 1)))
        return len(self.names) - 1

    def remove(self, name: str) -> None:
        if name in self.names:
            k = self.names.index(name)
            self.sums = np.delete(np.delete(self.sums, k, 2), k, 3)
            self.shift = np.delete(self.shift, k)
            for held in (self.names, self.own, self.ids):
                held.pop(k)

    def terms(self, packed: bytes | None) -> np.ndarray | None:
        """What a step's values add to the sums."""
        if not packed:
            return None
        held = np.frombuffer(packed, PAIR)
        at = {i: k for k, i in enumerate(self.ids)}
        places = np.array([at.get(i, -1) for i in held["id"].tolist()], np.int64)
        v, m = np.zeros(len(self.ids)), np.zeros(len(self.ids))
        known = places >= 0
        v[places[known]], m[places[known]] = held["v"][known] - self.shift[places[known]], 1.0
        return np.stack([np.outer(m, m), np.outer(v, m), np.outer(v * v, m), np.outer(v, v)])

    def correlations(self) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Window, places of the pairs' symbols, n and correlation."""
        order = sorted(range(len(self.names)), key=self.names.__getitem__)
        i, j = np.triu_indices(len(order), 1)
        i, j = np.array(order, np.int64)[i], np.array(order, np.int64)[j]
        for w, (n, s, q, x) in zip(self.windows, self.sums):
            count, d = n[i, j], np.maximum(n[i, j], 1)
            var = [a / d - (b / d) ** 2 for a, b in ((q[i, j], s[i, j]), (q[j, i], s[j, i]))]
            # What rounding leaves of a constant side is no variance.
            var = [np.where(v > 1e-12 * a / d, v, 0.0) for v, a in zip(var, (q[i, j], q[j, i]))]
            ok = (count > 1) & (var[0] * var[1] > 0)
            c = np.where(ok, (x[i, j] / d - s[i, j] * s[j, i] / d**2) / np.sqrt(np.where(ok, var[0] * var[1], 1.0)), 0.0)
            yield w, i, j, np.rint(count).astype(np.int64), c


class RollingCorrelation(StatefulProcessor):
    def __init__(self, windows: list[int], keys: list[str], rebuild: int = REBUILD):
        self.windows, self.keys, self.rebuild = windows, keys, rebuild

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.sums = handle.getValueState("sums", "names array<string>, own array<int>, ids array<int>, shift binary, sums binary, newest bigint, since int, next_id int")
        self.steps = handle.getMapState("steps", "step bigint", "held binary")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._save(self._take(initialState))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        sums = self._take(pd.concat(list(rows)))
        self._save(sums)
        lo, hi = key[-2:]
        for w, i, j, n, c in sums.correlations():
            own = np.array(sums.own)
            kept = np.ones(len(i), bool) if lo == hi else (own[i] == lo) != (own[j] == lo)
            names = np.array(sums.names, object)
            yield pd.DataFrame({**dict(zip(self.keys, key)), "steps": w, "symbol1": names[i[kept]], "symbol2": names[j[kept]], "n": n[kept], "correlation": c[kept], "newest": sums.newest, "drift": sums.drift})

    def close(self) -> None:
        pass

    def _save(self, sums: Sums) -> None:
        self.sums.update(sums.row())

    def _held(self, step: int) -> bytes | None:
        found = self.steps.getValue((step,))
        return bytes(found[0]) if found else None

    def _take(self, rows: pd.DataFrame) -> Sums:
        sums = Sums.load(self.windows, self.sums.get() if self.sums.exists() else None)
        for step, group in rows.sort_values("step", kind="stable").groupby("step", sort=True):
            for name in group.loc[group["source"] == "removed", "symbol"]:
                sums.remove(name)
            self._advance(sums, int(step))
            values = group[(group["source"] != "removed") & group["symbol"].notna() & group["value"].notna()]
            if len(values):
                self._add(sums, int(step), values)
            if sums.since >= self.rebuild:
                self._rebuild(sums)
        return sums

    def _advance(self, sums: Sums, step: int) -> None:
        """Takes away what leaves the windows when ``step`` is the newest."""
        if sums.newest is None or step <= sums.newest:
            sums.newest = step if sums.newest is None else sums.newest
            return
        longest = max(self.windows)
        # After a gap of a whole window no step is left.
        if step - sums.newest >= longest:
            self.steps.clear()
            sums.sums[:] = 0
        else:
            for k, w in enumerate(self.windows):
                for gone in range(sums.newest - w + 1, step - w + 1):
                    terms = sums.terms(self._held(gone))
                    if terms is not None:
                        sums.sums[k] -= terms
            for gone in range(sums.newest - longest + 1, step - longest + 1):
                if self.steps.containsKey((gone,)):
                    self.steps.removeKey((gone,))
        sums.since += step - sums.newest
        sums.newest = step

    def _add(self, sums: Sums, step: int, values: pd.DataFrame) -> None:
        inside = [k for k, w in enumerate(self.windows) if step > sums.newest - w]
        if not inside:
            return
        before = self._held(step)
        held = np.frombuffer(before, PAIR) if before else np.zeros(0, PAIR)
        # Of a symbol that was removed the map may still have values; its new id isn't among them.
        seen, new = set(held["id"].tolist()), []
        for name, own, value in zip(values["symbol"], values["own"], values["value"]):
            i = sums.ids[sums.place(name, int(own), float(value))]
            if i not in seen and np.isfinite(value):
                seen.add(i)
                new.append((i, value))
        if new:
            after = np.concatenate([held, np.array(new, PAIR)]).tobytes()
            change, old = sums.terms(after), sums.terms(before)
            sums.sums[inside] += change if old is None else change - old
            self.steps.updateValue((step,), (after,))

    def _rebuild(self, sums: Sums) -> None:
        steps = sorted((k[0], bytes(v[0])) for k, v in self.steps.iterator())
        before = [c for *_, c in sums.correlations()]
        n, s = sums.sums[int(np.argmax(self.windows)), :2]
        if len(sums.ids):
            sums.shift = sums.shift + np.diag(s) / np.maximum(np.diag(n), 1)
        sums.sums[:] = 0
        for step, packed in steps:
            terms = sums.terms(packed)
            for k, w in enumerate(self.windows):
                if step > sums.newest - w:
                    sums.sums[k] += terms
        sums.since = 0
        after = [c for *_, c in sums.correlations()]
        sums.drift = max([sums.drift or 0.0, *(float(np.abs(a - b).max(initial=0.0)) for a, b in zip(before, after))])


class DriftListener(StreamingQueryListener):
    """Collects the batches in which sums were made anew, and of these the ones whose correlations were off by more."""

    def __init__(self, tolerance: float = DRIFT_TOLERANCE):
        self.tolerance, self.checked, self.drifted = tolerance, [], []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        found = event.progress.observedMetrics.get("drift")
        if found is not None and found["worst"] is not None:
            self.checked.append(event.progress.batchId)
            if found["worst"] > self.tolerance:
                self.drifted.append((event.progress.batchId, found["worst"]))

    def onQueryTerminated(self, event) -> None:
        pass


def _by_block_pairs(values: DataFrame, keys: list[str], seconds: int, blocks: int) -> DataFrame:
    """Each row at all pairs of blocks: with its value at those of its own block, as a mark of the time at the others."""
    source = F.coalesce(F.col("source"), F.lit("live")) if "source" in values.columns else F.lit("live")
    step = F.floor(F.unix_seconds(F.col("start_time").cast("timestamp")) / seconds).cast("bigint")
    pairs = F.array(*[F.struct(F.lit(a).alias("lo"), F.lit(b).alias("hi")) for a in range(blocks) for b in range(a, blocks)])
    own = F.pmod(F.xxhash64("symbol"), F.lit(blocks)).cast("int")
    rows = values.select(*keys, "symbol", F.col("value").cast("double").alias("value"), step.alias("step"), own.alias("own"), source.alias("source"), F.explode(pairs).alias("pair"))
    here = (F.col("own") == F.col("pair.lo")) | (F.col("own") == F.col("pair.hi"))
    mine = lambda c: F.when(here, F.col(c)).alias(c)
    return rows.select(*keys, F.col("pair.lo").alias("lo"), F.col("pair.hi").alias("hi"), mine("symbol"), mine("value"), "step", "own", "source")


def rolling_correlation(values: DataFrame, windows: list[int], keys: list[str], seconds: int = 60, symbols: int = BLOCK_SYMBOLS, history: DataFrame | None = None, rebuild: int = REBUILD) -> DataFrame:
    """``keys``, lo, hi, steps, symbol1, symbol2, n, correlation, newest: all pairs of each window after each batch, a stream.

    ``values`` is a stream of symbol, start_time, value and perhaps source; a row whose symbol is null only moves the time.
    ``windows`` are in steps of ``seconds``; they end with the newest step. ``symbols`` is how many there may be: blocks are
    as many as keep about BLOCK_SYMBOLS in each. ``history`` is a batch frame like ``values`` that the state starts from: read
    it after the stream's position was taken (``latest_position``), and what lands between is in both and counts once.
    """
    keys = list(dict.fromkeys([*scope(values), *keys]))
    blocks = max(1, -(-symbols // BLOCK_SYMBOLS))
    by = [*keys, "lo", "hi"]
    out = ", ".join([*[f"{c} string" for c in keys], "lo int, hi int, steps int, symbol1 string, symbol2 string, n bigint, correlation double, newest bigint, drift double"])
    first = _by_block_pairs(history, keys, seconds, blocks).groupBy(*by) if history is not None else None
    return _by_block_pairs(values, keys, seconds, blocks).groupBy(*by).transformWithStateInPandas(RollingCorrelation(windows, by, rebuild), out, "Update", "None", initialState=first)


def land_correlation(values: DataFrame, work: str, windows: list[int], keys: list[str], seconds: int = 60, trigger: dict | None = None, **how) -> DataFrame:
    """Runs ``rolling_correlation`` and returns each market's last matrices; a batch that is run again replaces its rows."""
    from .queries import _run

    spark, path = values.sparkSession, f"{work}/matrices"
    rows = rolling_correlation(values, windows, keys, seconds, **how).observe("drift", F.max("drift").alias("worst"))
    spark.createDataFrame([], rows.schema).write.mode("ignore").parquet(f"{path}/batch=-1")
    _run(spark, rows.writeStream.outputMode("update").foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/batch={i}")), work, trigger)
    found = spark.read.schema(StructType([*rows.schema.fields, StructField("batch", LongType())])).parquet(path)
    by = list(dict.fromkeys([*scope(values), *keys]))
    # Marks of the time reach all blocks, so a market's last batch has all of its pairs.
    last = found.groupBy(*by).agg(F.max("batch").alias("batch"))
    return found.join(last, [*by, "batch"]).drop("batch", "lo", "hi", "drift")


def latest_position(log: DataFrame, id_col: str = "id") -> str | None:
    """The greatest id ``ms-seq`` of a landed log, None for an empty one: one value."""
    found = log.agg(F.max(stream_position(F.col(id_col))).alias("p")).select("p.*").first()
    return None if found[0] is None else f"{found[0]}-{found[1]}"


def after_position(log: DataFrame, position: str | None, id_col: str = "id") -> DataFrame:
    """The rows of a landed log, batch or stream, that come after ``position``; all for None."""
    if position is None:
        return log
    ms, seq = (int(x) for x in (*position.split("-"), "0")[:2])
    at = stream_position(F.col(id_col))
    return log.where((at["ms"] > ms) | ((at["ms"] == ms) & (at["seq"] > seq)))


def forced_by_newer(rows: DataFrame, expected: int) -> Stepped:
    """start_time, symbols, complete: each minute once, when its last symbol is there or a newer minute begins; for ``land``.

    What is held of a market is its newest minute, whether it was sent, and its symbols. Ticks (ts, event_type) count in the
    order of their minutes within a batch; those of an older minute, or of one that was sent, are late and dropped.
    """
    keys = scope(rows) or ["market"]
    each = rows.select(*(scope(rows) or [F.lit("").alias("market")]), F.date_trunc("minute", "ts").alias("start_time"), F.col("event_type").alias("symbol"))
    columns = ["start_time", "symbols", "complete"]
    schema = StructType.fromDDL(", ".join([*[f"{c} string" for c in keys], "start_time timestamp, symbols bigint, complete boolean, seen array<string>"]))

    def step(new: DataFrame, held: DataFrame) -> DataFrame:
        minutes = new.groupBy(*keys, "start_time").agg(F.collect_set("symbol").alias("seen")).withColumn("sent", F.lit(None).cast("boolean"))
        # ``sent`` is null where nothing was held of a minute.
        both = minutes.unionByName(held.select(*keys, "start_time", "seen", F.col("complete").alias("sent"))).where("start_time is not null")
        each = both.groupBy(*keys, "start_time").agg(F.array_distinct(F.flatten(F.collect_list("seen"))).alias("seen"), F.max("sent").alias("sent"))
        market = Window.partitionBy(*keys)
        each = each.withColumns({"newest": F.max("start_time").over(market), "before": F.max(F.when(F.col("sent").isNotNull(), F.col("start_time"))).over(market)})
        each = each.where("before is null or start_time >= before").withColumns({"full": F.size("seen") >= expected, "sent": F.coalesce("sent", F.lit(False)), "open": F.col("start_time") == F.col("newest")})
        count = F.least(F.size("seen"), F.lit(expected)).cast("bigint").alias("symbols")
        sent = each.where("not sent and (full or not open)").select(*keys, "start_time", count, F.col("full").alias("complete"), F.lit(None).cast("array<string>").alias("seen"), F.lit(False).alias("held"))
        kept = each.where("open").select(*keys, "start_time", count, (F.col("sent") | F.col("full")).alias("complete"), "seen", F.lit(True).alias("held"))
        return sent.unionByName(kept)

    return Stepped(each, step, schema, [*scope(rows), *columns])


def published_once(events: DataFrame, recent: int = RECENT, order: str = "arrival") -> Stepped:
    """The events (timestamp_ms, ``order``) whose time isn't among the last ``recent`` published times of their market; for ``land``.

    These times are what is held of a market. Spark sorts a batch behind them, and a task reads the sorted rows one part
    after the other.
    """
    keys = scope(events) or ["market"]
    each = events.select(*(scope(events) or [F.lit("").alias("market")]), F.col("timestamp_ms").cast("bigint").alias("timestamp_ms"), F.col(order).cast("bigint").alias(order)).where("timestamp_ms is not null")
    names = [*keys, "timestamp_ms", order, "place"]
    ddl = ", ".join([*[f"{c} string" for c in keys], f"timestamp_ms bigint, {order} bigint, place bigint"])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, held, known, last = None, [], set(), None

        def kept() -> pd.DataFrame:
            return pd.DataFrame([(*key, t, None, k, True) for k, t in enumerate(held)], columns=[*names, "held"])

        for frame in frames:
            out = []
            for at in frame[names].itertuples(index=False, name=None):
                if at[: len(keys)] != key:
                    if key is not None:
                        yield kept()
                    key, held, known, last = at[: len(keys)], [], set(), None
                time, came, place = at[len(keys) :]
                if time == last or (time in known and pd.isna(place)):
                    last = time
                    continue
                last = time
                held.append(time)
                known.add(time)
                if pd.isna(place):
                    out.append((*key, time, came, None, False))
                if len(held) > recent:
                    known.discard(held.pop(0))
            if out:
                yield pd.DataFrame(out, columns=[*names, "held"])
        if key is not None:
            yield kept()

    def step(new: DataFrame, held: DataFrame) -> DataFrame:
        both = held.unionByName(new.withColumn("place", F.lit(None).cast("bigint")))
        both = both.repartition(*keys).sortWithinPartitions(*keys, F.col("place").asc_nulls_last(), order, "timestamp_ms")
        return both.mapInPandas(run, f"{ddl}, held boolean")

    return Stepped(each, step, StructType.fromDDL(ddl), [*scope(events), "timestamp_ms", order])
