"""Benchmark decontamination with a BM25 inverted index of test items and block-max WAND.

The index holds the benchmark's items: postings of each term with BM25 impacts, in blocks of a few items that carry the
term's greatest impact. Impacts are divided by the item's score against itself, so a passage that holds all of an item
scores 1 and one threshold fits short and long items. Every training passage is a query. Passages are two adjoining
segments, a segment having as many words as the longest item, so each occurrence of an item lies whole in some passage; all
of a text is covered. Per segment the block maxima of its terms are added up, a sum over the sparse table of blocks; only
passages whose bound for some block reaches the threshold go on to block-max WAND, which returns every item at or over the
threshold. A match is then verified on word 5-gram shingles: at least 0.8 of the item's question and 0.8 of its answer
must be in the passage. Items that mark no question are cut at their last line break, or else at half their words.

The index is made in shards of ``items_per_shard`` items. One broadcast has the shards of at most ``items_per_pass`` items
and ``bytes_per_pass`` bytes of their texts (one item alone may be longer), and documents are read and cut into words once
for each broadcast. Frequencies are counted over all items.

Items without words match nothing; null texts have no words; texts shorter than a passage are one passage; long texts are
cut into words some pieces at a time. Repeated rows give repeated results, and repeated items each match; of equal scores
all stay. An empty table, or an empty benchmark, gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, keep_rows, located, saved, stable, table

K1, B = 1.2, 0.75
THRESHOLD = 0.6
OVERLAP = 0.8
SHINGLE = 5
ITEMS_PER_BLOCK = 4
ITEMS_PER_SHARD, ITEMS_PER_PASS, BYTES_PER_PASS = 1000, 50_000, 32 << 20
#: Parts of a pass's size that items are dealt to before parts are put together to passes.
PARTS = 16
CHUNK_WORDS = 200_000
WORD = re.compile(r"\w+")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def question_and_answer(text: str | None) -> tuple[list[str], list[str]]:
    text = text or ""
    cut = text.rfind("?") + 1 or text.rstrip().rfind("\n") + 1
    if cut and words(text[:cut]) and words(text[cut:]):
        return words(text[:cut]), words(text[cut:])
    w = words(text)
    return w[: (len(w) + 1) // 2], w[(len(w) + 1) // 2 :]


def shingles(w: list[str]) -> set[tuple[str, ...]]:
    return {tuple(w[i : i + SHINGLE]) for i in range(max(1, len(w) - SHINGLE + 1))} if w else set()


class Index:
    """Block-max inverted index of items given as (item_id, text); ``df`` and the means come from all items.

    ``vocabulary`` names the terms of all shards; this shard knows those in ``known``, in order.
    """

    def __init__(self, items: list[tuple[int, str]], df: dict[str, int], n_items: int, mean_words: float, vocabulary: dict[str, int] | None = None):
        items = sorted(((i, t or "") for i, t in items), key=lambda x: (len(words(x[1])), x[0] is None, x[0], x[1]))
        vocabulary = {} if vocabulary is None else vocabulary
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        tokens = [words(t) for t in self.texts]
        self.longest = max((len(w) for w in tokens), default=0)
        postings: list[tuple[int, int, float]] = []
        for at, w in enumerate(tokens):
            impact = {t: math.log1p((n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(w) / mean_words)) for t, n in Counter(w).items()}
            own = sum(impact.values())
            postings += [(vocabulary.setdefault(t, len(vocabulary)), at, x / own) for t, x in impact.items()]
        term, doc, value = (np.array([p[k] for p in sorted(postings)], kind) for k, kind in enumerate((np.int64, np.int64, np.float64)))
        self.known, first = np.unique(term, return_index=True)
        #: Postings of term t: docs and impacts from start[t] to start[t + 1].
        self.start, self.docs, self.impacts = [*first.tolist(), len(term)], array("i", doc.tolist()), array("d", value.tolist())
        # Blocks are ranges of items, the same for all terms, with each term's greatest impact there.
        self.blocks = max(1, -(-len(items) // ITEMS_PER_BLOCK))
        local = np.searchsorted(self.known, term)
        cell, at = np.unique(local * self.blocks + doc // ITEMS_PER_BLOCK, return_inverse=True)
        most = np.zeros(len(cell))
        np.maximum.at(most, at, value)
        self.cell_block, self.cell_most = cell % self.blocks, most
        self.cell_start = np.searchsorted(cell // self.blocks, np.arange(len(self.known) + 1))

    def local(self, ids: np.ndarray) -> np.ndarray:
        """This shard's numbers of terms of the vocabulary, -1 where it has none."""
        if not len(self.known):
            return np.full(len(ids), -1)
        at = np.minimum(np.searchsorted(self.known, ids), len(self.known) - 1)
        return np.where(self.known[at] == ids, at, -1)

    def bounds(self, row: np.ndarray, term: np.ndarray, rows: int) -> np.ndarray:
        """The sum of block maxima for each row, given by its terms, and block."""
        lo, n = self.cell_start[term], self.cell_start[term + 1] - self.cell_start[term]
        cell = np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.bincount(np.repeat(row, n) * self.blocks + self.cell_block[cell], self.cell_most[cell], rows * self.blocks).reshape(rows, self.blocks)

    def parts(self, item: int) -> list[set[tuple[str, ...]]]:
        """Shingles of the item's question and answer."""
        return [s for s in map(shingles, question_and_answer(self.texts[item])) if s]

    def search(self, terms: np.ndarray, threshold: float, blocks: list[int]) -> list[tuple[int, float]]:
        """Block-max WAND over ``blocks``: every item there whose impacts over ``terms`` add up to the threshold."""
        docs, impacts, start, out = self.docs, self.impacts, self.start, []
        least = threshold - 1e-6
        most = self.bounds(np.arange(len(terms)), terms, len(terms))
        for block in blocks:
            here = most[:, block]
            if here.sum() < least:
                continue
            end, lists = (block + 1) * ITEMS_PER_BLOCK, []
            for t, bound in zip(terms[here > 0].tolist(), here[here > 0].tolist()):
                at = bisect_left(docs, block * ITEMS_PER_BLOCK, start[t], start[t + 1])
                lists.append([docs[at], at, t, bound])
            while lists:
                lists.sort()
                bound, item = 0.0, -1
                for x in lists:
                    bound += x[3]
                    if bound >= least:
                        item = x[0]
                        break
                if item < 0:
                    break
                if lists[0][0] == item:
                    score = sum(impacts[at] for d, at, _, _ in lists if d == item)
                    if score >= least:
                        out.append((item, score))
                    item += 1
                # Lists before the pivot go on to it; after a scored pivot, past it.
                left = []
                for x in lists:
                    if x[0] < item:
                        at = bisect_left(docs, item, x[1], start[x[2] + 1])
                        if at == start[x[2] + 1] or docs[at] >= end:
                            continue
                        x[0], x[1] = docs[at], at
                    left.append(x)
                lists = left
        return out

    def verified(self, item: int, passage: set[tuple[str, ...]], w: list[str]) -> float | None:
        """The least share of the item's question and answer that the passage has, if it is enough."""
        shares = []
        for part in self.parts(item):
            size = len(next(iter(part)))
            have = passage if size == SHINGLE else {tuple(w[i : i + size]) for i in range(len(w) - size + 1)}
            shares.append(len(part & have) / len(part))
        return min(shares) if shares and min(shares) >= OVERLAP else None


def _matches(texts: list[str | None], shards: list[Index], vocabulary: dict[str, int], threshold: float) -> Iterator[tuple[int, int | None, float, float]]:
    """Position of the text, item_id, best score and best overlap."""
    tokens = [words(t) for t in texts]
    n = np.array([len(w) for w in tokens], np.int64)
    get = vocabulary.get
    ids = np.fromiter((get(x, -1) for w in tokens for x in w), np.int64, int(n.sum()))
    doc, inside = np.repeat(np.arange(len(texts)), n), np.arange(len(ids)) - np.repeat(np.cumsum(n) - n, n)
    for index in shards:
        step = index.longest
        if not step:
            continue
        local = index.local(ids)
        per = -(-n // step)
        first_segment = np.concatenate([[0], np.cumsum(per)])
        known, size = local >= 0, len(index.known)
        unique = np.unique((first_segment[doc[known]] + inside[known] // step) * size + local[known])
        bound = index.bounds(unique // size, unique % size, int(first_segment[-1]) + 1)
        both = bound[:-1] + bound[1:]
        last = np.zeros(len(both), bool)
        last[(first_segment[1:] - 1)[per > 0]] = True
        both[last] = bound[:-1][last]
        single = np.zeros(len(both), bool)
        single[first_segment[:-1][per == 1]] = True
        best: dict[tuple[int, int], tuple[float, float]] = {}
        for s in np.flatnonzero((both.max(1, initial=0) >= threshold - 1e-4) & (~last | single)).tolist():
            d = int(np.searchsorted(first_segment, s, "right")) - 1
            lo = (s - int(first_segment[d])) * step
            w = tokens[d][lo : lo + 2 * step]
            terms = index.local(np.unique([x for x in map(get, w) if x is not None]))
            found = index.search(terms[terms >= 0], threshold, np.flatnonzero(both[s] >= threshold - 1e-4).tolist())
            if found:
                have = shingles(w)
                for item, score in found:
                    share = index.verified(item, have, w)
                    if share is not None:
                        old = best.get((d, item), (0.0, 0.0))
                        best[d, item] = (max(old[0], score), max(old[1], share))
        for (d, item), (score, share) in best.items():
            yield d, index.ids[item], score, share


def packed(parts: list[tuple[int, int, int]], items: int, size: int) -> list[list[int]]:
    """Parts (id, items, bytes) put together in their order to passes within both bounds; one that is over alone stays alone."""
    out: list[list[int]] = []
    n = b = 0
    for part, more, long in sorted(parts):
        if not out or n + more > items or b + long > size:
            out.append([])
            n = b = 0
        out[-1].append(part)
        n, b = n + more, b + long
    return out


def _passes(benchmark: DataFrame, items_per_shard: int, items_per_pass: int, bytes_per_pass: int) -> Iterator[tuple[list[Index], dict[str, int]]]:
    """Shards and their vocabulary, of bounded size; frequencies of terms are counted by Spark over the whole benchmark."""
    items = saved(benchmark.select("item_id", F.col("text").cast("string").alias("text")).withColumn("row", F.monotonically_increasing_id()), "decontamination-items")

    def term_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [words(t) for t in batch.column("text").to_pylist()]
            rows = [(r, t, len(w)) for r, w in zip(batch.column("row").to_pylist(), each) for t in set(w)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in rows], kind) for k, kind in ((0, pa.int64()), (1, pa.string()), (2, pa.int64()))], ["row", "term", "n_words"])

    terms = saved(items.mapInArrow(term_rows, "row bigint, term string, n_words bigint"), "decontamination-terms")
    n, mean = terms.groupBy("row").agg(F.first("n_words").alias("n")).agg(F.count(F.lit(1)), F.avg("n")).first()
    if not n:
        return
    df = terms.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint")
    count, total = items.agg(F.count(F.lit(1)), F.sum(size)).first()
    n_parts = PARTS * max(-(-count // items_per_pass), -(-total // bytes_per_pass)) if count > items_per_pass or total > bytes_per_pass else 1
    part = F.pmod(F.xxhash64("row"), F.lit(n_parts))
    # A row for each part, so PARTS for each pass.
    parts = items.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).collect()
    for ids in packed([tuple(p) for p in parts], items_per_pass, bytes_per_pass):
        mine = items.where(part.isin(ids)) if n_parts > 1 else items
        used = terms.join(mine.select("row"), "row", "left_semi").select("term").distinct()
        rows, counts = [(r.item_id, r.text) for r in mine.toLocalIterator()], dict(map(tuple, df.join(used, "term").collect()))
        # Items of like length share a shard: its segments are as long as its longest item.
        rows.sort(key=lambda x: (len(words(x[1])), x[0] is None, x[0], x[1] or ""))
        vocabulary: dict[str, int] = {}
        yield [Index(rows[lo : lo + items_per_shard], counts, n, mean, vocabulary) for lo in range(0, len(rows), items_per_shard)], vocabulary


def find_matches(docs: DataFrame, benchmark: DataFrame, keep: list[str], threshold: float = THRESHOLD, items_per_shard: int = ITEMS_PER_SHARD, items_per_pass: int = ITEMS_PER_PASS, bytes_per_pass: int = BYTES_PER_PASS) -> DataFrame:
    """``keep`` columns, item_id, score and overlap, for each document and item that match."""
    rows = docs.select(*keep, docs["text"].cast("string").alias("__text"))
    names = [*keep, "item_id", "score", "overlap"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema[:-1]) + ", item_id bigint, score double, overlap double"
    spark = docs.sparkSession

    def of(shared) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards, vocabulary = shared.value
            for batch in batches:
                texts, lo = batch.column("__text").to_pylist(), 0
                while lo < len(texts):
                    hi, size = lo, 0
                    while hi < len(texts) and (hi == lo or size < CHUNK_WORDS * 6):
                        size += len(texts[hi] or "")
                        hi += 1
                    found = list(_matches(texts[lo:hi], shards, vocabulary, threshold))
                    if found:
                        at = pa.array([lo + x[0] for x in found])
                        yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keep), pa.array([x[1] for x in found], pa.int64()), pa.array([x[2] for x in found]), pa.array([x[3] for x in found])], names)
                    lo = hi

        return rows.mapInArrow(run, schema)

    found = [of(spark.sparkContext.broadcast(one)) for one in _passes(benchmark, items_per_shard, items_per_pass, bytes_per_pass)]
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], schema)


def kept_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The pipeline's stage: documents that match no item, with their own columns."""
    docs = stable(docs)
    at = located(docs, text="text")
    hit = saved(find_matches(at, benchmark, [FILE, ROW]).select(FILE, ROW).distinct(), "decontamination-hits")
    return keep_rows(docs, hit, "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])
