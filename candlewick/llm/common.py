"""Shared helpers: the work folder that all executors see, and tables cut from their lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below ``spark.checkpoint.dir``. Where that is unset, below a temporary one, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="candlewick-")
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet in the shared work folder and read again: cuts lineage, survives lost executors."""
    path = work_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discarded(df: DataFrame) -> None:
    """Deletes the files of a ``saved`` table that nothing reads any more."""
    spark = df.sparkSession
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def field(df: DataFrame, name: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return df["`" + name.replace("`", "``") + "`"]


def own_columns(df: DataFrame, of: DataFrame | None = None) -> list[Column]:
    """The columns of ``df``, or those of them that ``of`` names."""
    return [field(df, c) for c in (of or df).columns]


def without(df: DataFrame, *names: str) -> list[Column]:
    """The columns of ``df`` whose names, upper or lower case, aren't among ``names``."""
    return [field(df, c) for c in df.columns if c.lower() not in names]


#: Names of the locator's columns; a table must not have columns of these names.
FILE, ROW = "__loc_file", "__loc_row"


def located(docs: DataFrame, **cols: str) -> DataFrame:
    """``cols`` (new name=old name; by default all) of ``docs`` with a locator that stays the same at every reading.

    A plain Parquet scan has it in its metadata; any other frame is written out first.
    """
    picked = [field(docs, old).alias(new) for new, old in cols.items()] or own_columns(docs)
    try:
        meta = docs.metadataColumn("_metadata")
        return docs.select(*picked, meta["file_path"].alias(FILE), meta["row_index"].alias(ROW))
    except AnalysisException:
        return located(saved(docs.select(*picked), "located"))


def stable(docs: DataFrame) -> DataFrame:
    """``docs``, written out first unless it is a plain Parquet scan: its locators are then the same at every use."""
    try:
        docs.metadataColumn("_metadata")
        return docs
    except AnalysisException:
        return saved(docs, "stable")


def keep_rows(docs: DataFrame, keep: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of ``docs``, a Parquet scan, whose locators are in ``keep`` (left_anti: are not), with the columns of ``docs``."""
    keep = keep.select(F.col(FILE).alias("__keep_file"), F.col(ROW).alias("__keep_row"))
    at = located(docs)
    return at.join(keep, (at[FILE] == keep["__keep_file"]) & (at[ROW] == keep["__keep_row"]), how).select(*own_columns(at, docs))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
