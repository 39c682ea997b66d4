"""Vector codes by product quantisation, with nearest entries found by annular norm pruning.

Vectors become integers, are cut into ``PARTS`` parts, and each part position has a codebook that Lloyd rounds improve. To
find a part's nearest entry, the entries of its codebook are sorted by norm. The ``PROBES`` entries whose norms are nearest
to the part's give a first distance d; no entry nearer than d has a norm outside [norm - d, norm + d], as the difference of two norms is
at most the distance. A binary search finds that interval, and its entries, ends included, are evaluated in exact integers;
of those equally near the lower index counts. Norms are rounded, so the interval is wider by more than their rounding.
How much this saves is the data's: much where norms differ, little where parts of few components have like norms.

Each round is one pass over the table: tasks add up the parts of each entry, and Spark adds up the tasks' sums. The driver
holds the codebooks alone: ``ENTRIES`` vectors.

Vectors that are null, empty, or hold null or non-finite components are dropped, as are those of another length than the
one with the smallest vec_id: they have no such parts. Part k begins at component floor(k * length / PARTS). Of rows that
share a vec_id each has its own result, and they come in the order of their components; a null vec_id comes last. With
fewer than ``ENTRIES`` vectors there are as many entries as vectors; an empty table gives an empty result. Null labels are
one label. Components whose squared distances don't fit a long, from 2**20 on for parts of four, raise an error. Extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, saved, table

# Fixed values.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Vectors taken at a time, and entries that a part is held against before its annulus is known.
CHUNK, PROBES = 4096, 4


class Annuli:
    """One codebook sorted by norm."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        norms = np.sqrt((self.entries.astype(float) ** 2).sum(1))
        self.order = np.argsort(norms, kind="stable")
        self.norms, self.sorted = norms[self.order], self.entries[self.order]
        self.bits = max(1, (len(entries) - 1).bit_length())
        #: Distances worked out so far.
        self.evaluated = 0

    def _distance(self, parts: np.ndarray, at: np.ndarray) -> np.ndarray:
        self.evaluated += len(at)
        return ((parts - self.sorted[at]) ** 2).sum(1)

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the entry nearest to each of ``parts``."""
        most = max(int(np.abs(parts).max(initial=0)), int(np.abs(self.entries).max(initial=0)))
        if (4 * most**2 * max(parts.shape[1], 1)) << self.bits >= 1 << 63:
            raise ValueError("components are too large for integer distances")
        norm = np.sqrt((parts.astype(float) ** 2).sum(1))
        # The entries whose norms are nearest give the first distance.
        near = (np.searchsorted(self.norms, norm)[:, None] + np.arange(-PROBES // 2, PROBES // 2)).clip(0, len(self.norms) - 1)
        first = self._distance(np.repeat(parts, PROBES, 0), near.ravel()).reshape(near.shape).min(1)
        reach = np.sqrt(first.astype(float))
        slack = 1e-9 * (norm + reach + self.norms[-1]) + 1e-9
        lo, hi = np.searchsorted(self.norms, norm - reach - slack), np.searchsorted(self.norms, norm + reach + slack, "right")
        width = hi - lo
        heads = np.cumsum(width) - width
        row = np.repeat(np.arange(len(parts)), width)
        at = np.arange(len(row)) - heads[row] + lo[row]
        # Distance, then index, as one number.
        best = np.minimum.reduceat((self._distance(parts[row], at) << self.bits) | self.order[at], heads) if len(row) else np.zeros(0, np.int64)
        return best & ((1 << self.bits) - 1), best >> self.bits


def bounds(size: int) -> list[int]:
    return [k * size // PARTS for k in range(PARTS + 1)]


def vectors(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """First row and vectors (rows by components, in integers) of each chunk."""
    flat = batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
    for at in range(0, len(flat), CHUNK):
        yield at, flat[at : at + CHUNK].astype(np.int64)


def _sums(books: list[np.ndarray], size: int):
    edges = bounds(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, m = [Annuli(b) for b in books], len(books[0])
        count, total = np.zeros((PARTS, m), np.int64), np.zeros((m, size), np.int64)
        for batch in batches:
            for _, v in vectors(batch, size):
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    index, _ = annuli[k].nearest(v[:, a:b])
                    count[k] += np.bincount(index, minlength=m)
                    np.add.at(total[:, a:b], index, v[:, a:b])
        part = np.repeat(np.arange(PARTS), np.diff(edges))
        # A row for each entry and component; the entry's count goes along with each.
        entry, component = np.divmod(np.arange(m * size), max(size, 1))
        n = count[part[component], entry]
        used = n > 0
        yield pa.RecordBatch.from_arrays([pa.array(x[used]) for x in (entry, component, n, total.ravel())], ["entry", "component", "n", "total"])

    return run


def _codes(books: list[np.ndarray], size: int):
    edges = bounds(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli, hexes = [Annuli(b) for b in books], np.array([f"{i:02x}" for i in range(256)])
        for batch in batches:
            codes, errors = [], [np.zeros(0, np.int64)]
            for _, v in vectors(batch, size):
                error, index = np.zeros(len(v), np.int64), np.zeros((len(v), PARTS), np.int64)
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    index[:, k], far = annuli[k].nearest(v[:, a:b])
                    error += far
                codes += ["".join(row) for row in hexes[index]]
                errors.append(error)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(codes, pa.string()), pa.array(np.concatenate(errors))], ["vec_id", "label", "code", "error"])

    return run


def kept(table_: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """vec_id, label and v, the components as whole numbers, of the vectors that aren't dropped."""
    x = field(table_, vector_col).cast("array<double>")
    whole = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = table_.select(field(table_, id_col).alias("vec_id"), field(table_, label_col).alias("label"), x.alias("x")).where((F.size("x") > 0) & whole)
    return rows.select("vec_id", "label", F.transform("x", lambda c: F.floor(c * SCALE)).alias("v"))


class Codebooks:
    """Codebooks of all part positions, of ``size`` components together."""

    def __init__(self, rows: DataFrame, entries: int = ENTRIES, rounds: int = ROUNDS):
        if not 0 < entries <= 256:
            raise ValueError("a code has two hex digits")
        least = lambda of: [r.v for r in of.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(entries).collect()]
        first = least(rows)
        self.size = len(first[0]) if first else 0
        if any(len(v) != self.size for v in first):
            first = least(self.of(rows))
        self.whole = np.array(first, np.int64).reshape(len(first), self.size)
        for _ in range(rounds if first else 0):
            self._improve(rows)

    def books(self) -> list[np.ndarray]:
        edges = bounds(self.size)
        return [self.whole[:, a:b] for a, b in zip(edges, edges[1:])]

    def of(self, rows: DataFrame) -> DataFrame:
        return rows.where(F.size("v") == self.size)

    def _improve(self, rows: DataFrame) -> None:
        sums = self.of(rows).select("v").mapInArrow(_sums(self.books(), self.size), "entry bigint, component bigint, n bigint, total bigint")
        # As many rows as the codebooks have components.
        for r in sums.groupBy("entry", "component").agg(F.sum("n").alias("n"), F.sum("total").alias("total")).collect():
            self.whole[r.entry, r.component] = r.total // r.n

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books() for x in b.ravel()).encode()).hexdigest()


def compress(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks]:
    """vec_id, label, code and error of each vector, and the codebooks."""
    rows = kept(embeddings, id_col, vector_col, label_col)
    books = Codebooks(rows, entries, rounds)
    rows = books.of(rows)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    found = rows.mapInArrow(_codes(books.books(), books.size), f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error bigint") if books.size else rows.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"))
    return saved(found, "vector-codes"), books


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, books = compress(table(spark, sf_dir, "embeddings"))
    # One row for each label.
    sums = found.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of"), "label_error")
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(books.digest()).alias("codebooks_sha256"))


def _sql() -> str:
    def assign(name: str, books: str) -> str:
        far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT"
        return f"{name} AS MATERIALIZED (SELECT p.rn, p.part, min({far} * 64 + c.entry) AS best FROM p JOIN {books} c ON c.part = p.part GROUP BY 1, 2)"

    def improve(name: str, before: str, assigned: str) -> str:
        mean = f"(SELECT part, entry, list(m ORDER BY i) AS x FROM (SELECT part, best % 64 AS entry, i, floor(sum(x[i]) / count(*))::BIGINT AS m FROM {assigned} JOIN p USING (rn, part), unnest(range(1, len(x) + 1)) AS u(i) GROUP BY 1, 2, 3) GROUP BY 1, 2)"
        return f"{name} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.x, c.x) AS x FROM {before} c LEFT JOIN {mean} m USING (part, entry))"

    return f"""WITH k AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) AS rn, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rn, part, v[part * len(v) // 16 + 1 : (part + 1) * len(v) // 16] AS x FROM k, unnest(range(16)) AS u(part)),
b0 AS MATERIALIZED (SELECT part, rn - 1 AS entry, x FROM p WHERE rn <= 64),
{assign("a1", "b0")}, {improve("b1", "b0", "a1")}, {assign("a2", "b1")}, {improve("b2", "b1", "a2")}, {assign("a3", "b2")},
r AS (SELECT rn, string_agg(printf('%02x', best % 64), '' ORDER BY part) AS code, sum(best // 64)::BIGINT AS error FROM a3 GROUP BY 1)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(s, ',' ORDER BY part, entry)) FROM (SELECT part, entry, array_to_string(x, ',') AS s FROM b2)) AS codebooks_sha256 FROM k JOIN r USING (rn)"""


SQL = _sql()
