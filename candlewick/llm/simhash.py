"""SimHash near-deduplication by meet-in-the-middle ball hashing.

Two fingerprints at three or fewer differing bits meet half way: each emits every variant within half the radius. The
radius is odd, so one differing bit has to be taken out first: the 64 bits are cut into three blocks, and for each block
in turn the block is cleared and all variants of the remaining bits within radius one are emitted (131 variants). Of
two fingerprints within the radius, some block holds a differing bit (or there are two at most), so with that block
cleared they are within two bits and share a variant. Variants are shuffled, equal ones meet, and each candidate pair
is verified on the whole fingerprint.

Copies count once: the join runs over distinct fingerprints. A bucket of over ``bucket_pairs`` distinct fingerprints
emits no pairs; its members take a second, exact way: all variants within radius one (inner) and two (outer) of all 64
bits. In a bucket that has an inner member every other member is within three bits of it, so one link from each member
to one inner member loses no connection and needs no pairs. Components come from alternating large-star and small-star
rounds over the links, each round a shuffle with a map-side part. Least neighbours and names are written out before they
are joined, so that a join on a hub, or on the fingerprint of a third of all rows, can be split.

Null text counts as empty; texts without words share the zero fingerprint; long texts are read whole. Repeated rows get
equal results. A null doc_id is carried through and never names a component unless all of its members lack one. An empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, keep_rows, located, saved, stable, table

SEED = 42
RADIUS = 3
BLOCKS = ((0, 22), (22, 43), (43, 64))
BUCKET_PAIRS = 32
CHUNK_BYTES = 1 << 20


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """SimHash of each UTF-8 text over its 3-word shingles, ASCII-lower-cased."""
    out = np.zeros(len(texts), np.uint64)
    if not texts:
        return out
    with np.errstate(over="ignore"):
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        starts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])[:-1]])
        data = np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)
        space = (data == 32) | ((data >= 9) & (data <= 13))
        data[space] = 32
        # One space for each run of white space, so that a shingle is one slice.
        keep = ~(space & np.concatenate([[True], space[:-1]]))
        shift = np.cumsum(keep)
        doc_at = np.where(starts > 0, shift[np.maximum(starts - 1, 0)], 0)
        data, space = data[keep], space[keep]
        if not len(data):
            return out
        word = np.flatnonzero(~space & np.concatenate([[True], space[:-1]]))
        end = np.flatnonzero(~space & np.concatenate([space[1:], [True]])) + 1
        doc = np.searchsorted(doc_at, word, "right") - 1
        # Empty texts share a start with the next; the last of equal starts owns the word.
        n = np.bincount(doc, minlength=len(texts))
        first = np.concatenate([[0], np.cumsum(n)[:-1]])
        long = np.flatnonzero(n[doc] - (np.arange(len(word)) - first[doc]) >= 3)
        short = np.flatnonzero((n == 1) | (n == 2))
        s_start = np.concatenate([word[long], word[first[short]]])
        s_end = np.concatenate([end[long + 2], end[first[short] + n[short] - 1]])
        s_doc = np.concatenate([doc[long], short])
        if not len(s_doc):
            return out
        order = np.argsort(s_doc, kind="stable")
        joined, digest = data.tobytes(), xxhash.xxh64_intdigest
        h = np.fromiter((digest(joined[lo:hi], SEED) for lo, hi in zip(s_start[order].tolist(), s_end[order].tolist())), np.uint64, len(order))
        s_doc = s_doc[order]
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cut = np.flatnonzero(np.concatenate([[True], s_doc[1:] != s_doc[:-1]]))
        ones = np.add.reduceat(bits, cut, axis=0, dtype=np.int64)
        total = np.diff(np.concatenate([cut, [len(s_doc)]]))
        out[s_doc[cut]] = np.packbits(2 * ones > total[:, None], axis=1, bitorder="little").view("<u8")[:, 0]
    return out


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column("text")
        sizes = np.cumsum([len(x) for x in text.fill_null("").cast(pa.binary()).to_pylist()]) if batch.num_rows else np.zeros(0, int)
        fp, lo = np.zeros(batch.num_rows, np.uint64), 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(sizes, (sizes[lo - 1] if lo else 0) + CHUNK_BYTES, "right")))
            fp[lo:hi] = fingerprints(text.slice(lo, hi - lo).fill_null("").cast(pa.binary()).to_pylist())
            lo = hi
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in batch.schema.names if c != "text"), pa.array(fp.view(np.int64))], [*(c for c in batch.schema.names if c != "text"), "fp"])


def simhash(docs: DataFrame, id_cols: list[str], text_col: str = "text") -> DataFrame:
    """``id_cols`` and ``fp``, the 64-bit fingerprint as a long."""
    rows = docs.select(*id_cols, F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", fp bigint"
    return rows.mapInArrow(_fingerprint_batches, schema)


def _bits(lo: int, hi: int) -> int:
    return ((1 << hi) - 1) ^ ((1 << lo) - 1)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x)


def _masks() -> list[tuple[int, int]]:
    out = []
    for lo, hi in BLOCKS:
        rest = ~_bits(lo, hi) & (2**64 - 1)
        out += [(_signed(rest), 0)] + [(_signed(rest), _signed(1 << b)) for b in range(64) if not lo <= b < hi]
    return out


def _variants(fps: DataFrame) -> DataFrame:
    """key, fp: for each block, the fingerprint without it and with at most one of the other bits flipped."""
    masks = F.array(*[F.struct(F.lit(m).cast("long").alias("rest"), F.lit(f).cast("long").alias("flip")) for m, f in _masks()])
    return fps.select("fp", F.explode(masks).alias("m")).select(F.col("fp").bitwiseAND(F.col("m.rest")).bitwiseXOR(F.col("m.flip")).alias("key"), "fp")


def _runs(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted (key, fp) rows cut where keys change: key, fp, and the length of the row's run, over ``limit`` as ``limit`` + 1.

    Of a run that goes on in the next batch, at most ``limit`` + 1 rows are held back.
    """
    key, fp, long = np.zeros(0, np.int64), np.zeros(0, np.int64), None
    for batch in batches:
        k, f = (np.concatenate([a, batch.column(c).to_numpy(zero_copy_only=False)]) for a, c in ((key, "key"), (fp, "fp")))
        if not len(k):
            continue
        tail = int(np.searchsorted(k, k[-1], "left"))
        if len(k) - tail > limit:
            run, long, tail = _lengths(k, long, limit), k[-1], len(k)
            yield k, f, run
        else:
            yield k[:tail], f[:tail], _lengths(k[:tail], long, limit)
            if long is not None and k[-1] == long:
                yield k[tail:], f[tail:], np.full(len(k) - tail, limit + 1)
                tail = len(k)
        key, fp = k[tail:], f[tail:]
    if len(key):
        yield key, fp, _lengths(key, long, limit)


def _lengths(k: np.ndarray, long, limit: int) -> np.ndarray:
    """The length of each row's run; the key ``long`` began in an earlier batch and is over the limit."""
    if not len(k):
        return np.zeros(0, int)
    cut = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    n = np.diff(np.concatenate([cut, [len(k)]]))
    return np.repeat(np.where((n > limit) | (k[cut] == long if long is not None else False), limit + 1, n), n)


def _canonical(a: np.ndarray, b: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a pair is to be reported from this bucket: the other buckets that it shares stay silent."""
    out = np.zeros(len(a), bool)
    for lo, hi in BLOCKS:
        rest = np.uint64(~_bits(lo, hi) & (2**64 - 1))
        x, y = a.view(np.uint64) & rest, b.view(np.uint64) & rest
        diff = x ^ y
        low = diff & (~diff + np.uint64(1))
        n = _popcount(diff)
        out |= key.view(np.uint64) == np.where(n < 2, x, np.where(n == 2, x ^ low, key.view(np.uint64) + np.uint64(1)))
    return out


def _links(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """a, b: a verified pair; b null: a is in a bucket over the limit."""
        with np.errstate(over="ignore"):
            for key, fp, n in _runs(batches, limit):
                a_out, b_out = [], []
                some = n > 1
                key, fp, n = key[some], fp[some], n[some]
                small = n <= limit
                k, f = key[small], fp[small]
                for d in range(1, limit):
                    if len(k) <= d:
                        break
                    same = k[d:] == k[:-d]
                    if not same.any():
                        break
                    x, y, kk = f[:-d][same], f[d:][same], k[d:][same]
                    near = _popcount((x ^ y).view(np.uint64)) <= RADIUS
                    x, y, kk = x[near], y[near], kk[near]
                    one = _canonical(x, y, kk) & (x != y)
                    a_out.append(x[one]), b_out.append(y[one])
                a = np.concatenate(a_out) if a_out else np.zeros(0, np.int64)
                b = np.concatenate(b_out) if b_out else np.zeros(0, np.int64)
                hot = np.unique(fp[~small])
                if len(a) or len(hot):
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, hot])), pa.array(np.concatenate([b, np.zeros_like(hot)]), mask=np.concatenate([np.zeros(len(a), bool), np.ones(len(hot), bool)]))], ["a", "b"])

    return run


def _ball(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """v, outer, fp: all variants within two bits."""
    one = np.uint64(1) << np.arange(64, dtype=np.uint64)
    i, j = np.triu_indices(64, 1)
    flips = np.concatenate([[np.uint64(0)], one, one[i] | one[j]])
    outer = np.repeat(np.array([0, 1], np.int8), [65, len(i)])
    for batch in batches:
        for lo in range(0, batch.num_rows, 64):
            fp = batch.column("fp").slice(lo, 64).to_numpy(zero_copy_only=False)
            v = (fp.view(np.uint64)[:, None] ^ flips[None, :]).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(v.ravel()), pa.array(np.tile(outer, len(fp))), pa.array(np.repeat(fp, len(flips)))], ["v", "outer", "fp"])


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by v, outer, fp: a link from each row to the first inner row of its v."""
    last_v = last_center = None
    for batch in batches:
        v, outer, fp = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("v", "outer", "fp"))
        if not len(v):
            continue
        cut = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        n = np.diff(np.concatenate([cut, [len(v)]]))
        center, has = fp[cut].copy(), outer[cut] == 0
        if last_v is not None and v[0] == last_v:
            center[0], has[0] = (last_center, True) if last_center is not None else (0, False)
        last_v, last_center = v[-1], center[-1] if has[-1] else None
        a, b, ok = fp, np.repeat(center, n), np.repeat(has, n)
        ok &= a != b
        if ok.any():
            pairs = np.unique(np.stack([a[ok], b[ok]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def links(fps: DataFrame, bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """a, b: links between the distinct fingerprints ``fps.fp`` that connect all pairs within the radius."""
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = saved(_variants(fps).repartition(n, "key").sortWithinPartitions("key", "fp").mapInArrow(_links(bucket_pairs), "a bigint, b bigint"), "simhash-links")
    pairs = found.where("b is not null")
    hot = found.where("b is null").select(F.col("a").alias("fp")).distinct()
    stars = hot.repartition(n, "fp").mapInArrow(_ball, "v bigint, outer tinyint, fp bigint").repartition(n, "v").sortWithinPartitions("v", "outer", "fp").mapInArrow(_stars, "a bigint, b bigint")
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root: the least node reachable, for each node of ``edges`` (a, b)."""
    e = saved(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "components")
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = saved(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "components-least")
        large = saved(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.where("u <> m").select("u", F.col("m").alias("v"))).distinct(), "components-large")
        least = saved(large.groupBy("u").agg(F.min("v").alias("m")), "components-least")
        joined = large.join(least, "u")
        e = saved(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "components")
        now = tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            return e.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        before = now


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_pairs: int = BUCKET_PAIRS) -> DataFrame:
    """doc_id, fp, component_id, kept and the locator for each row of ``docs``."""
    at = located(docs, doc_id=id_col, text=text_col)
    rows = saved(simhash(at, ["doc_id", FILE, ROW]), "simhash")
    fps = saved(rows.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", FILE, ROW)).alias("best")), "simhash-distinct")
    roots = components(links(fps.select("fp"), bucket_pairs))
    member = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "best", F.coalesce("root", "fp").alias("root"))
    member = saved(member, "simhash-members")
    best = member.groupBy("root").agg(F.min("best").alias("best"))
    named = saved(member.select("fp", "root").join(best, "root").select("fp", "best"), "simhash-named")
    return rows.join(named, "fp").select(
        "doc_id",
        "fp",
        F.col("best.doc_id").alias("component_id"),
        ((F.col("best")[FILE] == F.col(FILE)) & (F.col("best")[ROW] == F.col(ROW))).alias("kept"),
        FILE,
        ROW,
    )


def kept_documents(docs: DataFrame) -> DataFrame:
    """The pipeline's stage: of each component the row with the smallest doc_id stays."""
    docs = stable(docs)
    return keep_rows(docs, near_duplicates(docs).where("kept"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
