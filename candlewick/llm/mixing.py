"""Mixing sources to target weights by Pfair scheduling.

Each source is cut into blocks of ``block_rows`` rows. In the ideal mix, sources flow at once in proportion to their
weights; one that has run out leaves, and the others go on with their shares of the rest. Block ``i`` of a source is
released in the slot in which its flow reaches ``i`` blocks and due when it reaches ``i + 1``; one block goes into each
slot, the released block with the earliest deadline first (ties by name). Blocks are as long as slots and no more flows
into any stretch of slots than it has, so every deadline is met: any prefix of the mix, also after sources have run out,
deviates from the ideal mix by less than one block for every source, and no slot stays empty.

Weights are integers, so whenever every source has flowed for a whole number of its weights, all are even. Between two
such points lies a unit, which can be scheduled alone. Units without a source that runs out in them repeat; all others
are as many as sources at most. The driver sorts the sources' ends, O(S log S) for S sources; tasks schedule one unit of
each kind, and its blocks are a table that is joined with the rows. That table is never larger than the blocks. One task
holds one unit, whose slots are the sum of the weights at most (which state shares, so their size is the caller's, not the
data's), and never more than there are blocks; what was scheduled up to a slot depends on all slots before it.

Rows stand inside a source in the order of the MD5 of their identifier, then of their locator. Ranks come from counts
over sorted ranges of that order, so a source that holds a third of all rows, or rows that all lack an identifier, are
dealt to many tasks. A null source is a source of its own, named ``(none)``; sources without a target get the weight 1.
Empty texts and long ones count as any row. Empty tables give empty results. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Mapping
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, located, saved, stable, table, without

BLOCK_ROWS = 16
#: Target weights of the registered query and the pipeline; every other source has weight 1.
WEIGHTS = {"src0": 5, "src1": 3, "src2": 2, "src3": 2}
NONE = "(none)"
#: Slots of a unit that leave a task in one batch.
UNIT_ROWS = 50_000


def unit(weights: list[int], blocks: list[int]) -> list[tuple[int, int]]:
    """(source, block) for each slot of a unit in which source k has ``blocks[k]`` blocks, at most ``weights[k]``."""
    going = sum(w for w, n in zip(weights, blocks) if n == w)
    ends = sorted((Fraction(n, w), w, n) for w, n in zip(weights, blocks) if n < w)
    at, flowing, stopped = [e[0] for e in ends], [sum(e[1] for e in ends)], [0]
    for _, w, n in ends:
        flowing.append(flowing[-1] - w)
        stopped.append(stopped[-1] + n)

    def reached(w: int) -> list[tuple[int, int]]:
        """The slot, rounded down and up, in which a source of weight ``w`` has flowed for j blocks."""
        out = []
        for j in range(w + 1):
            k = bisect_right(at, Fraction(j, w)) if at else 0
            flow = (going + flowing[k]) * j + stopped[k] * w
            out.append((flow // w, -(-flow // w)))
        return out

    times = {w: reached(w) for w in set(weights)}
    jobs = sorted((times[w][j][0], times[w][j + 1][1], k, j) for k, (w, n) in enumerate(zip(weights, blocks)) for j in range(n))
    ready: list[tuple[int, int, int]] = []
    out, following = [], 0
    for t in range(len(jobs)):
        while following < len(jobs) and jobs[following][0] <= t:
            heapq.heappush(ready, jobs[following][1:])
            following += 1
        _, k, j = heapq.heappop(ready)
        out.append((k, j))
    return out


class Plan:
    """The kinds of units of a mix: where each begins, in units and in slots, and how many slots one unit has."""

    def __init__(self, blocks: Mapping[str, int], weights: Mapping[str, int]):
        self.names = sorted(s for s, n in blocks.items() if n)
        self.blocks = np.array([blocks[s] for s in self.names], np.int64)
        self.weights = np.array([weights.get(s, 1) for s in self.names], np.int64)
        whole, rest = np.divmod(self.blocks, self.weights) if self.names else (self.blocks, self.blocks)
        #: Sources end in a unit, or before it; either way another kind begins there, and one after a unit with an end.
        self.first = np.unique(np.concatenate([[0], whole, whole[rest > 0] + 1]).astype(np.int64))[:-1]
        order = np.argsort(whole, kind="stable")
        gone = np.concatenate([[0], np.cumsum(self.weights[order])])
        left = gone[-1] - gone[np.searchsorted(whole[order], self.first, "right")]
        own = np.zeros(len(self.first), np.int64)
        np.add.at(own, np.searchsorted(self.first, whole[rest > 0]), rest[rest > 0])
        self.slots = left + own
        units = np.diff(np.concatenate([self.first, [whole.max(initial=0) + 1]]))
        self.start = np.concatenate([[0], np.cumsum(self.slots * units)[:-1]]).astype(np.int64)

    def rows_of(self, kind: int) -> list[tuple[int, str, int, int]]:
        """kind, source, block in the unit, slot in the unit."""
        here = np.minimum(self.blocks - self.weights * self.first[kind], self.weights)
        some = np.flatnonzero(here > 0).tolist()
        return [(kind, self.names[some[k]], j, t) for t, (k, j) in enumerate(unit(self.weights[some].tolist(), here[some].tolist()))]


def _placed(rows: DataFrame) -> DataFrame:
    """``rows`` (doc_id, source, locator) with their rank in the source, and its number of rows."""
    order = F.unhex(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")))
    # A hash stands for the file's path, as Spark samples these columns on the driver.
    keys = ["source", "order", F.xxhash64(FILE), ROW]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.withColumn("order", order).repartitionByRange(n, *keys).sortWithinPartitions(*keys, FILE)
    dealt = saved(dealt.withColumn("at", F.monotonically_increasing_id()).drop("order"), "mixing-order").withColumn("range", F.shiftright("at", 33))
    counts = dealt.groupBy("source", "range").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    by = Window.partitionBy("source")
    before = F.coalesce(F.sum("here").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = saved(counts.select("source", "range", (before - F.col("first")).alias("shift"), F.sum("here").over(by).alias("n")), "mixing-ranges")
    return dealt.join(counts, ["source", "range"]).select("doc_id", "source", FILE, ROW, (F.col("at") + F.col("shift")).alias("rank"), "n")


def mix(docs: DataFrame, weights: Mapping[str, int] = WEIGHTS, id_col: str = "doc_id", source_col: str = "source", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """doc_id, source, block, place (in its block), slot and the locator for each row of ``docs``."""
    spark = docs.sparkSession
    rows = located(docs, doc_id=id_col, source=source_col).withColumn("source", F.coalesce(F.col("source").cast("string"), F.lit(NONE)))
    ranked = saved(_placed(rows), "mixing-ranked")
    # A row for each source reaches the driver.
    plan = Plan({r.source: -(-r.n // block_rows) for r in ranked.groupBy("source").agg(F.max("n").alias("n")).collect()}, weights)
    shared = spark.sparkContext.broadcast(plan)

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for kind in batch.column("id").to_pylist():
                rows = shared.value.rows_of(kind)
                for lo in range(0, len(rows), UNIT_ROWS):
                    kinds, sources, blocks, offsets = zip(*rows[lo : lo + UNIT_ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int64()), pa.array(sources, pa.string()), pa.array(blocks, pa.int64()), pa.array(offsets, pa.int64())], ["kind", "source", "j", "offset"])

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = shared.value
        for batch in filter(lambda b: b.num_rows, batches):
            source, rank = batch.column("source"), batch.column("rank").to_numpy()
            block = rank // block_rows
            code = source.dictionary_encode()
            weight = plan.weights[np.array([bisect_left(plan.names, x) for x in code.dictionary.to_pylist()], np.int64)[code.indices.to_numpy()]]
            at = block // weight
            kind = np.searchsorted(plan.first, at, "right") - 1
            base = plan.start[kind] + (at - plan.first[kind]) * plan.slots[kind]
            own = [batch.column(c) for c in ("doc_id", "source", FILE, ROW)]
            yield pa.RecordBatch.from_arrays([*own, *map(pa.array, (block, (rank % block_rows).astype(np.int32), kind, block - at * weight, base))], ["doc_id", "source", FILE, ROW, "block", "place", "kind", "j", "base"])

    kinds = len(plan.first)
    schedule = saved(spark.range(0, kinds, 1, min(max(kinds, 1), 1000)).mapInArrow(units, "kind bigint, source string, j bigint, offset bigint"), "mixing-units")
    schema = f"doc_id {ranked.schema['doc_id'].dataType.simpleString()}, source string, {FILE} string, {ROW} bigint, block bigint, place int, kind bigint, j bigint, base bigint"
    out = ranked.drop("n").mapInArrow(placed, schema).join(schedule, ["kind", "source", "j"])
    return out.select("doc_id", "source", "block", "place", (F.col("base") + F.col("offset")).alias("slot"), FILE, ROW)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop(FILE, ROW)


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's last stage: all rows of ``docs``, with slot and place, the order to train in.

    Columns of ``docs`` named slot or place give way to these.
    """
    docs = stable(docs)
    at = located(docs)
    placed = mix(docs).select(F.col(FILE).alias("__mix_file"), F.col(ROW).alias("__mix_row"), F.col("slot").alias("__mix_slot"), F.col("place").alias("__mix_place"))
    both = at.join(placed, (at[FILE] == placed["__mix_file"]) & (at[ROW] == placed["__mix_row"]))
    return both.select(*without(at, "slot", "place", FILE, ROW), F.col("__mix_slot").alias("slot"), F.col("__mix_place").alias("place"))
