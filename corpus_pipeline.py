"""From raw documents to a mixed training order, in five stages, each written as Parquet and read by the next.

Rows are judged by their place in the files, so repeated rows and rows that share a doc_id are rows of their own, and columns
of any other name, clashing ones too, go through. Null and empty texts have no language and go at the first stage; of equal
texts, and of each near-duplicate group, the row with the smallest doc_id stays. Texts are read whole. An empty table gives an
empty result with the last stage's columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from candlewick.llm import decontamination, exact_dedup, language_id, mixing, simhash
from candlewick.llm.common import table, work_dir

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

STAGES: list[tuple[str, Stage]] = [
    ("language_id", lambda spark, docs, sf_dir: language_id.kept_documents(docs)),
    ("exact_dedup", lambda spark, docs, sf_dir: exact_dedup.kept_documents(docs)),
    ("simhash_near_dedup", lambda spark, docs, sf_dir: simhash.kept_documents(docs)),
    ("benchmark_decontamination", lambda spark, docs, sf_dir: decontamination.kept_documents(docs, table(spark, sf_dir, "benchmark"))),
    ("mixing", lambda spark, docs, sf_dir: mixing.mixed_documents(docs)),
]

#: Language profiles, XXH64 fingerprints and the mix's schedule have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = work_dir(spark, f"pipeline-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
