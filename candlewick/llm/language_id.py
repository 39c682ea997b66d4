"""Language identification by rank-order n-gram profiles and the out-of-place distance.

A profile is the ``top`` most frequent character n-grams (one to three letters, inside words padded with a blank) in
order of their counts. Profiles of languages are learned from all labelled training documents: each task counts the
n-grams of its documents with numpy, Spark adds the counts up, and a window with a limit keeps the top ranks of each
language. A document's own profile, from its whole text, is then compared: the distance to a language is the sum over
the document's n-grams of how far they stand out of place, ``top`` where the language lacks them. The least distance
wins, ties by name.

Text that is null or without letters gets ``und`` with score 0, and so does every text when no language was learned.
Texts are read whole, long ones in pieces. Rows are independent, so repeated rows get equal results; null labels are no
language; extra columns are ignored; an empty table gives an empty result.

The pipeline's stage rejects a document when its language is ``und``, when it lies far from all profiles (a score under
``LEAST_SCORE``: another script or no language at all), or when its own label names a learned language and another one was
predicted. Documents without a label, or with the label of no learned language, are judged by the first two alone. The
label has no part in the prediction.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, keep_rows, located, saved, stable, table

TOP = 400
CHUNK = 1 << 20
BLANK = 32
#: Least score at which the pipeline's stage keeps a document.
LEAST_SCORE = 0.25


class Letters:
    """Whether a code point is a letter, for all of Unicode; made once a worker."""

    made: np.ndarray | None = None

    @classmethod
    def table(cls) -> np.ndarray:
        if cls.made is None:
            cls.made = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        return cls.made


def ngram_ids(text: str) -> np.ndarray:
    """All 1- to 3-grams of one piece of text as packed code points; a blank stands for what is no letter."""
    a = np.frombuffer((" " + text.lower() + " ").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    a = np.where(Letters.table()[a], a, BLANK)
    a = a[np.concatenate([[True], (a[1:] != BLANK) | (a[:-1] != BLANK)])]
    if len(a) < 3:
        return np.zeros(0, np.int64)
    two, letter = (a[:-1] << 21) | a[1:], a != BLANK
    three = (two[:-1] << 21) | a[2:]
    return np.concatenate([a[letter], two, three[letter[1:-1]]])


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of a whole text and their counts, long texts by pieces that end at a blank."""
    ids, n, lo = [], [], 0
    while lo < len(text):
        hi = min(len(text), lo + CHUNK)
        while hi < len(text) and text[hi - 1].isalpha() and hi - lo < 2 * CHUNK:
            hi += 1
        i, c = np.unique(ngram_ids(text[lo:hi]), return_counts=True)
        ids.append(i), n.append(c)
        lo = hi
    if len(ids) == 1:
        return ids[0], n[0]
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    i, at = np.unique(np.concatenate(ids), return_inverse=True)
    return i, np.bincount(at, np.concatenate(n), len(i)).astype(np.int64)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lang, gram, n: partial counts of a task, handed on whenever a buffer of about a million characters is full."""

    def flush(lang: str, parts: list[str]) -> pa.RecordBatch:
        ids, n = counted("\n".join(parts))
        return pa.RecordBatch.from_arrays([pa.array([lang] * len(ids), pa.string()), pa.array(ids), pa.array(n)], ["lang", "gram", "n"])

    held: dict[str, list[str]] = {}
    size: dict[str, int] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            held.setdefault(lang, []).append(text)
            size[lang] = size.get(lang, 0) + len(text)
            if size[lang] >= CHUNK:
                yield flush(lang, held.pop(lang))
                size[lang] = 0
    for lang, parts in held.items():
        yield flush(lang, parts)


def learn(labelled: DataFrame, top: int = TOP) -> DataFrame:
    """lang, gram, rank (from 0) of every language in ``labelled`` (text, lang), by count and then by code points."""
    rows = labelled.where("text is not null and lang is not null").select("lang", "text")
    counts = rows.mapInArrow(_count_batches, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    return counts.withColumn("rank", place - 1).where(F.col("rank") < top).select("lang", "gram", "rank")


class Profiles:
    """Learned profiles as one table: n-grams by languages, ``top`` where a language lacks one."""

    def __init__(self, rows: list[tuple[str, int, int]], top: int = TOP):
        self.top = top
        self.langs = sorted({r[0] for r in rows})
        self.grams = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int64)
        for lang, gram, rank in rows:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def predict(self, text: str | None) -> tuple[str, float]:
        ids, n = counted(text or "")
        if not len(ids) or not self.langs:
            return "und", 0.0
        order = np.lexsort((ids, -n))[: self.top]
        ids = ids[order]
        at = np.minimum(np.searchsorted(self.grams, ids), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == ids)[:, None], self.ranks[at], -1)
        away = np.where(ranks < 0, self.top, np.abs(ranks - np.arange(len(ids))[:, None])).sum(0)
        best = int(np.argmin(away))
        return self.langs[best], 1.0 - float(away[best]) / (self.top * len(ids))


def predict(docs: DataFrame, profiles: DataFrame, keep: list[str], top: int = TOP) -> DataFrame:
    """``keep`` columns, lang_pred and score. The profiles are ``top`` rows for each language."""
    model = Profiles([tuple(r) for r in profiles.select("lang", "gram", "rank").collect()], top)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.predict(t) for t in batch.column("__text").to_pylist()]
            cols = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())], [*keep, "lang_pred", "score"])

    rows = docs.select(*keep, docs["text"].cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", lang_pred string, score double"
    return rows.mapInArrow(run, schema)


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def identify(docs: DataFrame, keep: list[str], top: int = TOP) -> DataFrame:
    """Learns from the labelled documents outside the held-out fold and predicts for all.

    ``keep`` must have no column lang_pred or score.
    """
    return predict(docs, profiles_of(docs, top), keep, top)


def profiles_of(docs: DataFrame, top: int = TOP) -> DataFrame:
    train = docs.where(F.coalesce(fold(F.col("doc_id")) != 2, F.lit(True))).select("text", F.col("lang").cast("string").alias("lang"))
    return saved(learn(train, top), "language-profiles")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: the rows of ``docs`` that are not rejected, with their own columns."""
    docs = stable(docs)
    at = located(docs, doc_id="doc_id", text="text", label="lang")
    profiles = profiles_of(docs)
    learned = [r.lang for r in profiles.select("lang").distinct().collect()]
    found = predict(at, profiles, ["label", FILE, ROW])
    wrong = F.col("label").cast("string").isin(learned) & (F.col("label").cast("string") != F.col("lang_pred")) if learned else F.lit(False)
    rejected = (F.col("lang_pred") == "und") | (F.col("score") < LEAST_SCORE) | F.coalesce(wrong, F.lit(False))
    return keep_rows(docs, saved(found.where(rejected).select(FILE, ROW), "language-rejected"), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify(table(spark, sf_dir, "documents"), ["doc_id"])
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
