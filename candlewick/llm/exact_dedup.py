"""Exact deduplication as a stateful stream over disk-backed keyed state.

Every row is reduced to the SHA-256 of its normalised text, its stable identifier and a content locator (file and row
index). A Structured Streaming aggregation keyed by digest keeps, in RocksDB and without expiry, the smallest
identifier seen with its locator and the number of rows; a restart from the checkpoint goes on where it stopped. Hits,
digests that the state has counted more than once, are then checked on full bytes: their rows are grouped by digest and
text, an aggregate with a map-side part, so a group holding a third of all rows shuffles one text per map task. Up to
``max_hits`` of them are broadcast (32 bytes each), so that no other text is moved; beyond, the aggregate takes all rows.
Digests whose texts differ are resolved by digest and text.

Nulls count as empty text. A row without identifier never wins over one that has one. Rows that repeat an identifier
in one group: the one with the least locator stays. Texts are read whole, whatever their length. Extra columns, whatever
their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, keep_rows, located, saved, stable, table, work_dir

#: Bytes of identifiers and digests, about a hundredth of the texts, that one micro-batch takes.
MAX_BYTES_PER_TRIGGER = 16 << 30
#: Digests that are broadcast for the check on bytes, 32 MB.
MAX_HITS = 1_000_000
WHITE_SPACE = r"[\x20\x09-\x0D]+"
ROCKSDB = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "4",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE_SPACE, " ")


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _state(spark: SparkSession, rows_path: str, schema, work: str, max_bytes_per_trigger: int, max_files_per_trigger: int | None) -> DataFrame:
    """Runs the stream over the rows below ``rows_path`` to its end; one row per digest: keep, n."""
    before = {k: spark.conf.get(k, None) for k in ROCKSDB}
    updates = f"{work}/updates"
    try:
        for k, v in ROCKSDB.items():
            spark.conf.set(k, v)
        limit = {"maxFilesPerTrigger": max_files_per_trigger} if max_files_per_trigger else {"maxBytesPerTrigger": max_bytes_per_trigger}
        rows = spark.readStream.schema(schema).options(**limit).parquet(rows_path)
        state = rows.groupBy("digest").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)).alias("keep"),
            F.count(F.lit(1)).alias("n"),
        )
        empty = spark.createDataFrame([], state.schema)
        empty.write.parquet(f"{updates}/batch=-1")
        query = (
            state.writeStream.outputMode("update")
            .trigger(availableNow=True)
            .option("checkpointLocation", f"{work}/checkpoint")
            .foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{updates}/batch={i}"))
            .start()
        )
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    last = spark.read.schema(empty.schema).parquet(updates).groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last"))
    return last.select("digest", "last.keep", "last.n")


def stateful_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Callable[[Column], Column] = sha256,
    max_bytes_per_trigger: int = MAX_BYTES_PER_TRIGGER,
    max_files_per_trigger: int | None = None,
    max_hits: int = MAX_HITS,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_digest and the locator.

    ``digest`` turns the normalised text into the binary key of the state; a weak one still gives right groups, as
    bytes are compared on hits. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    at = located(docs, doc_id=id_col, text=text_col)
    full = at.select("doc_id", normalised(F.col("text")).alias("norm"), FILE, ROW).withColumn("digest", digest(F.col("norm")))
    work = work_dir(spark, "exact-dedup")
    light = full.select("doc_id", "digest", FILE, ROW)
    light.write.parquet(f"{work}/rows")
    rows = spark.read.schema(light.schema).parquet(f"{work}/rows")
    state = saved(_state(spark, f"{work}/rows", light.schema, work, max_bytes_per_trigger, max_files_per_trigger), "exact-dedup-state")
    hits = state.where("n > 1").select("digest")
    again = full.join(F.broadcast(hits), "digest", "left_semi") if hits.limit(max_hits + 1).count() <= max_hits else full
    groups = again.groupBy("digest", "norm").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)).alias("keep"), F.count(F.lit(1)).alias("n"))
    # The texts themselves are only needed where they differ.
    differing = saved(groups.groupBy("digest").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("digest"), "exact-dedup-differing")
    result = _resolved(rows, state)
    if differing.isEmpty():
        return result
    sure = rows.join(differing, "digest", "left_anti")
    split = _kept(full.join(differing, "digest", "left_semi").join(groups.join(differing, "digest", "left_semi"), ["digest", "norm"]))
    return _resolved(sure, state).unionByName(split)


def _resolved(rows: DataFrame, state: DataFrame) -> DataFrame:
    return _kept(rows.join(state, "digest"))


def _kept(joined: DataFrame) -> DataFrame:
    return joined.select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        ((F.col("keep")[FILE] == F.col(FILE)) & (F.col("keep")[ROW] == F.col(ROW))).alias("kept"),
        F.col("digest").alias("text_digest"),
        FILE,
        ROW,
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the rows of ``docs`` that stay, with their own columns."""
    docs = stable(docs)
    return keep_rows(docs, stateful_dedup(docs).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stateful_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("text_digest")).alias("text_sha256"))


SQL = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY h) AS kept, h AS text_sha256
FROM d
"""
