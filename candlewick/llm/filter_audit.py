"""Audit of how filters interact: which of five filters removes what, in every order, by scanning Arrow buffers.

A task sees the bytes of its texts as one Arrow buffer. NumPy gives each byte its classes by table; prefix sums of the
classes, read at the documents' offsets, count words, capitals, symbols and code points. Prefix sums of a polynomial give
each word a hash that doesn't depend on where it stands; the hashes are sorted within each document, neighbours of equal
hash are compared byte by byte, and a document in which two of them differ is counted by a set of its words. So the number
of distinct words is exact. A document is then a mask of the filters it fails.

Whether a text is identical to that of a smaller doc_id is known from the whole table: masks are counted by SHA-256 of the
text, and the least doc_id of a digest passes. What meets in one place for a digest, however often it is copied, is a row
for each part and label that it stands with. At last a part has 32 masks at most, and all orders reduce them.

Null text is empty text; a null or empty part is the empty string; a null doc_id has no label, is no smaller one and is
larger than none. Rows that share a doc_id count one by one, and none of them is smaller than the other. A document with
several rows in the labels is good (toxic) if one of them says so. Long texts are scanned by windows of ``WINDOW`` bytes
that end between words; only their words' hashes and places are held whole. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import field, table

# The filters' limits and the bytes of their classes.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SPACE, CAPITALS, SYMBOLS = b"\x20\x09\x0a\x0b\x0c\x0d", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
FILTERS = "ABCDE"

WINDOW, GROUP = 1 << 20, 1 << 22
IS_SPACE, IS_CAPITAL, IS_SYMBOL, IS_POINT = 1, 2, 4, 8


def _classes() -> np.ndarray:
    of = np.where((np.arange(256) & 0xC0) != 0x80, IS_POINT, 0).astype(np.uint8)
    for bytes_, bit in ((SPACE, IS_SPACE), (CAPITALS, IS_CAPITAL), (SYMBOLS, IS_SYMBOL)):
        of[list(bytes_)] |= bit
    return of


CLASSES = _classes()
#: A value for each byte, and an odd base with its inverse, all modulo 2**64.
VALUES = np.random.default_rng(12).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Scanner:
    """Counts of texts that lie in one buffer, ``offsets`` apart."""

    def __init__(self, window: int = WINDOW, values: np.ndarray = VALUES):
        self.window, self.values = window, values
        self.up = self.down = np.zeros(0, np.uint64)

    def _window_end(self, data: np.ndarray, offsets: np.ndarray, start: int) -> int:
        """The end of the window: the next text or space after its size."""
        end = start + self.window
        if end >= offsets[-1]:
            return int(offsets[-1])
        stop = int(offsets[np.searchsorted(offsets, end)])
        for a in range(end, stop, self.window):
            found = np.flatnonzero(CLASSES[data[a : min(a + self.window, stop)]] & IS_SPACE)
            if len(found):
                return a + int(found[0])
        return stop

    def _words(self, data: np.ndarray, classes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and hashes of a window's words."""
        if len(self.up) <= len(data):
            self.up, self.down = _powers(BASE, 2 * len(data) + 1), _powers(INVERSE, 2 * len(data) + 1)
        inside = np.zeros(len(data) + 2, bool)
        inside[1:-1] = (classes & IS_SPACE) == 0
        cut = bounds[bounds < len(data)]
        first = inside[1:-1] & ~inside[:-2]
        first[cut] = inside[1:-1][cut]
        last = inside[1:-1] & ~inside[2:]
        cut = cut[cut > 0] - 1
        last[cut] = inside[1:-1][cut]
        s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
        run = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=run[1:])
        return s, e, (run[e] - run[s]) * self.down[s]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """words, distinct, capitals, symbols and points of each text."""
        n = len(offsets) - 1
        out = {k: np.zeros(n, np.int64) for k in ("words", "distinct", "capitals", "symbols", "points")}
        held, at = [], int(offsets[0])
        while at < offsets[-1]:
            end = self._window_end(data, offsets, at)
            i, j = np.searchsorted(offsets, at, "right") - 1, np.searchsorted(offsets, end)
            bounds = np.clip(offsets[i : j + 1], at, end) - at
            classes = CLASSES[data[at:end]]
            for name, bit in (("capitals", IS_CAPITAL), ("symbols", IS_SYMBOL), ("points", IS_POINT)):
                run = np.concatenate([[0], np.cumsum(classes & bit != 0)])
                out[name][i:j] += run[bounds[1:]] - run[bounds[:-1]]
            s, e, h = self._words(data[at:end], classes, bounds)
            held.append((s + at, e + at, h))
            at = end
        if held:
            s, e, h = (np.concatenate(x) for x in zip(*held))
            doc = np.searchsorted(offsets, s, "right") - 1
            out["words"] = np.bincount(doc, minlength=n)
            out["distinct"] = self._distinct(data, s, e, h, doc, n)
        return out

    def _distinct(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        order = np.lexsort((h, doc))
        s, e, h, doc = s[order], e[order], h[order], doc[order]
        again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1]))
        same = self._equal(data, s[again], e[again], s[again + 1], e[again + 1])
        out = np.bincount(doc, minlength=n) - np.bincount(doc[again], minlength=n)
        for d in np.unique(doc[again[~same]]):
            own = doc == d
            out[d] = len({data[a:b].tobytes() for a, b in zip(s[own], e[own])})
        return out

    def _equal(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
        """Whether the words of each pair have the same bytes; compared so many bytes at a time."""
        same = (e - s) == (e2 - s2)
        rest = np.flatnonzero(same)
        size = (e - s)[rest]
        ends = np.cumsum(size)
        at = 0
        while at < len(rest):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + self.window, "right")))
            k, long = rest[at:to], size[at:to]
            heads = np.cumsum(long) - long
            step = np.arange(heads[-1] + long[-1]) - np.repeat(heads, long)
            equal = data[np.repeat(s[k], long) + step] == data[np.repeat(s2[k], long) + step]
            same[k] = np.logical_and.reduceat(equal, heads)
            at = to
        return same


def fails(counts: dict[str, np.ndarray]) -> np.ndarray:
    """The mask of the first four filters; bit i stands for FILTERS[i]."""
    words, distinct = counts["words"], counts["distinct"]
    each = [words < LEAST_WORDS, 100 * distinct < LEAST_DISTINCT * words, 100 * counts["capitals"] > MOST_CAPITALS * counts["points"], counts["symbols"] > 0]
    return sum(x.astype(np.int32) << i for i, x in enumerate(each))


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings, without a copy of the bytes."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, kind)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), at.astype(np.int64)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    scanner = Scanner()
    for batch in batches:
        data, offsets = buffer_of(batch.column("text"))
        at, masks = 0, []
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + GROUP, "right")) - 1)
            masks.append(fails(scanner.counts(data, offsets[at : to + 1])))
            at = to
        digests = [hashlib.sha256(data[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:])]
        mask = np.concatenate(masks) if masks else np.zeros(0, np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), pa.array(mask, pa.int32()), pa.array(digests, pa.binary())], ["doc_id", "part", "mask", "digest"])


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, mask (of the first four filters), digest of each row."""
    rows = docs.select(field(docs, id_col).cast("bigint").alias("doc_id"), F.coalesce(field(docs, part_col).cast("string"), F.lit("")).alias("part"), field(docs, text_col).cast("string").alias("text"))
    return rows.mapInArrow(_scan, "doc_id bigint, part string, mask int, digest binary")


def masks(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask (of all five filters), n, good, toxic: how many documents have each mask, and how many of them are labelled so."""
    one = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(c)
    own = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality", "toxic").where("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic"))
    # One row for each doc_id and text, so that a repeated doc_id is known.
    ids = rows.join(own, "doc_id", "left").groupBy("doc_id", "digest", "part", "mask", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"))
    each = ids.groupBy("digest", "part", "mask", "quality", "toxic").agg(
        F.sum("n").alias("n"), F.coalesce(F.sum(F.when(F.col("doc_id").isNull(), F.col("n"))), F.lit(0)).alias("nameless"), F.min("doc_id").alias("first"), F.min_by("n", "doc_id").alias("firsts")
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    kept = F.col("nameless") + F.when(F.col("first") == least, F.col("firsts")).otherwise(0)
    split = each.withColumn("kept", kept).select("part", "mask", "quality", "toxic", F.explode(F.array(F.struct(F.lit(0).alias("copy"), F.col("kept").alias("n")), F.struct(F.lit(1 << 4).alias("copy"), (F.col("n") - F.col("kept")).alias("n")))).alias("s"))
    n = F.col("s.n")
    count = lambda c: F.sum(F.when(F.col(c), n).otherwise(0)).alias(c)
    return split.groupBy("part", (F.col("mask") + F.col("s.copy")).cast("int").alias("mask")).agg(F.sum(n).alias("n"), count("quality"), count("toxic"))


#: Orders of the filters as rows of bit numbers.
ORDERS = np.array(list(permutations(range(len(FILTERS)))))
COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def reduced(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The COUNTS of each order and step (orders by steps) from the documents of each of the 32 masks."""
    bits = (np.arange(1 << len(FILTERS))[:, None] >> np.arange(len(FILTERS))) & 1 == 1
    failing = bits.T[ORDERS]  # order, step, mask: whether the step's filter fails the mask
    before = np.cumsum(failing, 1) - failing > 0
    here = failing & ~before
    size = bits.sum(1)
    out = {"kept": (~(before | failing)) @ n, "removed": here @ n, "redundant": (failing & before) @ n, "unique_fails": (failing & (size == 1)) @ n, "good_lost": here @ good, "toxic_lost": here @ toxic}
    total = np.array([out["removed"][ORDERS == f].sum() for f in range(len(FILTERS))])
    return out | {"shapley": total[ORDERS]}


def _reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = pa.array(["".join(FILTERS[i] for i in o) for o in ORDERS for _ in FILTERS])
    steps = pa.array(np.tile(np.arange(1, len(FILTERS) + 1, dtype=np.int32), len(ORDERS)))
    for batch in batches:
        for part, rows in zip(batch.column("part").to_pylist(), batch.column("masks").to_pylist()):
            by = np.zeros((3, 1 << len(FILTERS)), np.int64)
            for r in rows:
                by[:, r["mask"]] += [r["n"], r["quality"], r["toxic"]]
            counts = reduced(*by)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(names)), names, steps, *[pa.array(counts[c].ravel()) for c in COUNTS]], ["part", "filter_order", "step", *COUNTS])


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step and COUNTS, for each part, order of the filters and step."""
    found = masks(scanned(docs, id_col, text_col, part_col), labels)
    parts = found.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "quality", "toxic")).alias("masks"))
    return parts.mapInArrow(_reduce, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in COUNTS))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  {'A': len(ws) < 200, 'B': 100 * len(list_distinct(ws)) < 50 * len(ws), 'C': 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 3 * length(t), 'D': regexp_matches(t, '[#$%&*|]'),
   'E': coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false)} AS f FROM w LEFT JOIN l USING (doc_id)),
f AS (SELECT part, good, toxic, concat(CASE WHEN f.A THEN 'A' ELSE '' END, CASE WHEN f.B THEN 'B' ELSE '' END, CASE WHEN f.C THEN 'C' ELSE '' END, CASE WHEN f.D THEN 'D' ELSE '' END, CASE WHEN f.E THEN 'E' ELSE '' END) AS fs FROM m),
g AS (SELECT part, fs, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY 1, 2),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT a.c || b.c || c.c || d.c || e.c AS filter_order FROM x a, x b, x c, x d, x e WHERE len(list_distinct([a.c, b.c, c.c, d.c, e.c])) = 5),
s AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step FROM o),
r AS (SELECT part, filter_order, step, filter_order[step] AS c, n, good, toxic, fs, contains(fs, filter_order[step]) AS failing,
  len(list_filter(range(1, step), lambda i: contains(fs, filter_order[i]))) > 0 AS before FROM g, s),
t AS (SELECT part, filter_order, step, c, sum(CASE WHEN NOT failing AND NOT before THEN n ELSE 0 END) AS kept, sum(CASE WHEN failing AND NOT before THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN failing AND before THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fs = c THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN failing AND NOT before THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN failing AND NOT before THEN toxic ELSE 0 END) AS toxic_lost FROM r GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM t"""
