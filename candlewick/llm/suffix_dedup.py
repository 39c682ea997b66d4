"""Removal of repeated byte strings through common-prefix interval trees over a sparse, distributed suffix array.

A string of ``min_bytes`` bytes that occurs twice has the same minimiser in both places: the least hash among its
``GRAM``-byte substrings. So only suffixes that start at minimisers (about one in 170 bytes) are indexed. Suffixes whose
``GRAM``-gram has no partner go first, by counts with a map-side part. Suffixes whose whole context (what a repeat through
this place can need: ``min_bytes`` to the right, ``min_bytes - GRAM`` to the left) is equal are one entry with a count,
however many there are.

A repeat through an anchor reaches r bytes ahead of it and at least ``min_bytes - r`` back. The values of r are cut into
two bands; entries that share a repeat with lo <= r < hi agree in lo bytes ahead and ``min_bytes + 1 - hi`` back, so these
bytes' hash deals the entries out into buckets that can be built apart. Entries alone in their bucket go.

A bucket of more than ``bucket_limit`` entries is first cut along one path of its tree, that of the entry with the most
copies (in every second round: of the one with the greatest hash). Each other entry is compared with that one, which gives
the repeat that the two share. Any repeat that goes farther is shared with entries that leave the path at the same byte, to
the right or to the left; these are the subtrees at the path, buckets of their own, and are cut again while they are large.
So a round makes two rows of an entry at most, however many share a passage.

Spark sorts each bucket by the bytes to the right; neighbouring entries give the longest common prefixes. A stack scan
over these yields the common-prefix intervals, children before parents; within each, the entries are set in the order of
what stands to their left, and where left extensions differ a maximal repeat ends: the interval's prefix with the left
extension shared by two or more entries. All entries of an interval count, not just neighbours. Every occurrence
whose left and right parts reach ``min_bytes`` together is covered by the repeat, and the union over a document goes.

Trees and paths compare bytes. Equal contexts are told by 128 bits of hash, and their bytes aren't compared again.

Passages of many short words stay under ``min_bytes``. With ``min_words`` the same way is taken once more, over texts written
as a row of hashes, ``WORD`` bytes for each word, so that a string of ``min_words * WORD`` bytes is a passage of that many
words; what lies between two words doesn't count. These passages are counted beside the others, and nothing of them is removed.

Null text counts as empty. Matches never cross documents; overlapping occurrences in one document count. Exact copies,
repeated rows included, remove each other. Texts of any length are read whole, in pieces that overlap. An empty table gives
an empty result. Rows are told apart by file and position, so a doc_id may be null or repeat. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FILE, ROW, discarded, located, saved, table

MIN_BYTES = 400
GRAM = 64
#: Entries of a bucket that one tree is built over.
BUCKET_LIMIT = 1000
PIECE = 1 << 18
#: Words of a passage that ``query`` counts, and bytes of a word's hash.
MIN_WORDS = 51
WORD = 8
SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SPACE = re.compile(b"[" + b"".join(SPACES) + b"]")
#: Rows of a batch that become Python objects at once.
ROWS = 256
U = np.uint64
BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
#: A random number for each byte value, so that no text is made to collide.
BYTES = np.random.default_rng(64).integers(0, 1 << 64, 256, U)


class Powers:
    """Powers of the two bases and of their inverses modulo 2**64, grown as needed."""

    made: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    @classmethod
    def get(cls, n: int) -> list[tuple[np.ndarray, np.ndarray]]:
        if cls.size < n:
            cls.size, cls.made = n, []
            for base in BASES:
                one = []
                for b in (base, pow(base, -1, 1 << 64)):
                    p = np.full(n, b, U)
                    p[0] = 1
                    one.append(np.cumprod(p, dtype=U))
                cls.made.append((one[0], one[1]))
        return cls.made


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(32))) * U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U(29))) * U(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> U(32))


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of x[i : i + w] for each i."""
    n = len(x) - w + 1
    padded = np.concatenate([x, np.full(-len(x) % w, ~U(0))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def anchors_of(pieces: list[tuple[bytes, int, int]], min_bytes: int, gram: int, width: int = 1) -> tuple[np.ndarray, ...]:
    """Minimisers of the windows that start at lo <= p < hi of each piece (bytes, lo, hi).

    All lengths and places are counted in symbols of ``width`` bytes, one or ``WORD``. Returns the piece, position in it, bytes of context to the left and right, hash of the gram, two of the context, and
    the keys of the two bands with whether there are bytes enough for them.
    """
    with np.errstate(over="ignore"):
        sizes = np.array([len(p[0]) // width for p in pieces], np.int64)
        start = np.cumsum(sizes) - sizes
        joined = b"".join(p[0] for p in pieces)
        data = BYTES[np.frombuffer(joined, np.uint8)] if width == 1 else np.frombuffer(joined, U)
        n = len(data)
        (up1, down1), (up2, down2) = Powers.get(max(n + 1, 2 * PIECE))
        sum1, sum2 = (np.concatenate([np.zeros(1, U), np.cumsum(data * d[:n], dtype=U)]) for d in (down1, down2))
        h = _mix((sum1[gram:] - sum1[:-gram]) * up1[: n - gram + 1])
        key = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=U)
        least = _window_min(key, min_bytes - gram + 1)
        valid = np.zeros(len(least) + 1, np.int64)
        lo = start + np.array([p[1] for p in pieces])
        hi = start + np.array([p[2] for p in pieces])
        some = hi > lo
        np.add.at(valid, lo[some], 1)
        np.add.at(valid, np.minimum(hi[some], len(least)), -1)
        at = (least[np.cumsum(valid[:-1]) > 0] & U(0xFFFFFF)).astype(np.int64)
        at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
        piece = np.searchsorted(start, at, "right") - 1
        pos = at - start[piece]
        left = np.minimum(pos, min_bytes - gram)
        right = np.minimum(sizes[piece] - pos, min_bytes)
        s, e = at - left, at + right
        shape = (left * (min_bytes + 1) + right).astype(U)
        c1 = _mix((sum1[e] - sum1[s]) * up1[s] + shape)
        c2 = _mix((sum2[e] - sum2[s]) * up2[s] + shape)
        keys = []
        for k, (lo, high) in enumerate(bands_of(min_bytes, gram)):
            back = min_bytes + 1 - high
            fits = (left >= back) & (right >= lo)
            s, e = np.where(fits, at - back, at), np.where(fits, at + lo, at)
            keys += [_mix((sum1[e] - sum1[s]) * up1[s] + U(k)), fits]
        return piece, pos, left, right, h[at], c1, c2, *keys


def bands_of(min_bytes: int, gram: int) -> list[tuple[int, int]]:
    """The two bands of bytes ahead: lo <= r < hi."""
    middle = max(gram, min_bytes // 2) + 1
    return [(gram, middle), (middle, min_bytes + 1)]


def hashed_words(texts: list[bytes]) -> list[bytes]:
    """The words of each text, maximal runs of ``[^\\x20\\x09-\\x0D]``, as ``WORD`` bytes each."""
    text = b" ".join(texts)
    hashes, starts = [], []
    lo = 0
    while lo < len(text):
        cut = SPACE.search(text, lo + PIECE)
        end = hi = cut.start() if cut else len(text)
        last = 1 + max(lo - 1, *(text.rfind(x, lo, lo + PIECE) for x in SPACES))
        # A word of more than a piece, the last of its part, has a hash that needs no powers.
        if hi - last > PIECE:
            end = last
        part = np.frombuffer(text, np.uint8, end - lo, lo)
        space = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        edges = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]])))
        s, e = edges[::2], edges[1::2]
        with np.errstate(over="ignore"):
            up, down = Powers.get(max(len(part) + 1, 2 * PIECE))[0]
            total = np.concatenate([np.zeros(1, U), np.cumsum(BYTES[part] * down[: len(part)], dtype=U)])
            hashes.append(_mix((total[e] - total[s]) * up[s] + (e - s).astype(U)))
        starts.append(s + lo)
        if end < hi:
            hashes.append(np.frombuffer(hashlib.blake2b(memoryview(text)[end:hi], digest_size=WORD).digest(), U))
            starts.append(np.array([end]))
        lo = hi
    if not hashes:
        return [b""] * len(texts)
    ends = np.searchsorted(np.concatenate(starts), np.cumsum([len(t) + 1 for t in texts])).tolist()
    words = np.concatenate(hashes).tobytes()
    return [words[a * WORD : b * WORD] for a, b in zip([0, *ends], ends)]


def _read(rows: Iterator[tuple], width: int) -> Iterator[tuple]:
    """Rows whose last value is a text in UTF-8: that text itself or, for a ``width`` of ``WORD``, its hashed words."""
    if width == 1:
        yield from rows
        return
    part: list[tuple] = []
    size = 0
    for row in rows:
        part.append(row)
        size += len(row[-1])
        if size >= PIECE:
            yield from ((*x[:-1], words) for x, words in zip(part, hashed_words([x[-1] for x in part])))
            part, size = [], 0
    yield from ((*x[:-1], words) for x, words in zip(part, hashed_words([x[-1] for x in part])))


def _slices(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.RecordBatch]:
    """Batches in parts of ``rows`` rows; what Arrow holds in reserve goes back after each batch."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)
        del batch
        pa.default_memory_pool().release_unused()


def _anchor_batches(min_bytes: int, gram: int, piece_bytes: int, width: int):
    shortest, step = min_bytes // width, piece_bytes // width
    names = ["f", "r", "pos", "left", "right", "gram", "c1", "c2", "k1", "k2"]

    def emit(keys: list[tuple], pieces: list[tuple[bytes, int, int]], last: list) -> pa.RecordBatch:
        piece, pos, left, right, h, c1, c2, *keyed = anchors_of(pieces, shortest, gram // width, width)
        f, r, base = (np.array([k[i] for k in keys], np.int64)[piece] for i in range(3))
        place = np.stack([f, r, (base + pos) * width])
        # Where a text is cut, both pieces may report the same place.
        new = (place != np.concatenate([np.array(last)[:, None], place[:, :-1]], axis=1)).any(0)
        last[:] = place[:, -1].tolist() if len(f) else last
        cols = [*place, (left * width).astype(np.int16), (right * width).astype(np.int16), *(x.view(np.int64) for x in (h, c1, c2))]
        bands = [pa.array(k[new].view(np.int64), mask=~ok[new]) for k, ok in (keyed[:2], keyed[2:])]
        return pa.RecordBatch.from_arrays([*(pa.array(c[new]) for c in cols), *bands], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple] = []
        pieces: list[tuple[bytes, int, int]] = []
        size, last = 0, [-1, -1, -1]
        for batch in _slices(batches):
            rows = zip(*(batch.column(c).to_pylist() for c in ("f", "r", "text")))
            for f, r, text in _read(((f, r, (text or "").encode("utf-8", "surrogatepass")) for f, r, text in rows), width):
                length = len(text) // width
                starts = length - shortest + 1
                for lo in range(0, max(starts, 0), step):
                    hi = min(lo + step, starts)
                    # A margin on both sides, so that contexts don't depend on where pieces are cut.
                    a, b = max(0, lo - shortest), min(length, hi + 2 * shortest)
                    keys.append((f, r, a))
                    pieces.append((text[a * width : b * width], lo - a, hi - a))
                    size += (b - a) * width
                    if size >= piece_bytes:
                        yield emit(keys, pieces, last)
                        keys, pieces, size = [], [], 0
        if pieces:
            yield emit(keys, pieces, last)

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts as compressed bytes, for the shuffle."""
    zip_ = zstandard.ZstdCompressor(level=1)
    for batch in _slices(batches):
        text = [zip_.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column("text").to_pylist()]
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(text, pa.binary())], [*names, "zip"])


ENTRY = "key binary, large boolean, c1 bigint, c2 bigint, n bigint, back binary, ahead binary"
#: A cut along a path: the entry in its subtree, and what it shares with the path. Rows without a key are the paths' own.
CUT = "key binary, c1 bigint, c2 bigint, n bigint, back binary, ahead binary, left bigint, right bigint"
KINDS = {"binary": pa.binary(), "boolean": pa.bool_(), "bigint": pa.int64()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], KINDS[k]) for i, (_, k) in enumerate(fields)], [n for n, _ in fields])


def _context_batches(min_bytes: int, width: int):
    """The entries of a text, with the bytes on both sides that their band can need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        for batch in _slices(batches):
            out: list[tuple] = []
            at = batch.column("at")
            fields = at.flatten()
            entries = zip(*(fields.field(c).to_pylist() for c in ("key", "large", "c1", "c2", "n", "pos", "lo", "hi")))
            texts = ((n, unzip.decompress(z)) for n, z in zip(pc.list_value_length(at).to_pylist(), batch.column("zip").to_pylist()))
            for n, text in _read(texts, width):
                for key, large, c1, c2, copies, p, lo, hi in islice(entries, n):
                    out.append((key, large, c1, c2, copies, text[max(0, p - min_bytes + lo) : p][::-1], text[p : p + hi - 1]))
                    if len(out) >= 2000:
                        yield _batch(out, ENTRY)
                        out = []
            if out:
                yield _batch(out, ENTRY)

    return run


def _path_batches(min_bytes: int):
    """Entries (with their path's c1, c2, n, back and ahead as a struct) cut along it, CUT."""

    def subtree(key: bytes, side: bytes, path: bytes) -> bytes:
        return hashlib.blake2b(path, digest_size=16, key=key, person=side).digest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out: list[tuple] = []
            own: dict[tuple, list[int]] = {}
            for key, c1, c2, n, back, ahead, path in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "n", "back", "ahead", "path"))):
                if (c1, c2) == (path["c1"], path["c2"]):
                    continue
                right, left = common(ahead, path["ahead"]), common(back, path["back"])
                shared = (left, right) if left + right >= min_bytes else (None, None)
                if shared[0] is not None:
                    most = own.setdefault((path["c1"], path["c2"], path["n"]), [0, 0])
                    most[:] = max(most[0], left), max(most[1], right)
                keys = [subtree(key, b"right", ahead[: right + 1])] if right < len(ahead) else []
                keys += [subtree(key, b"left", back[: left + 1])] if left < len(back) else []
                out += [(k, c1, c2, n, back, ahead, *shared) for k in keys or [None]]
            out += [(None, *which, None, None, *most) for which, most in own.items()]
            if out:
                yield _batch(out, CUT)

    return run


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int]) -> Iterator[tuple[int, int, int]]:
    """Common-prefix intervals (length, first, last) of a suffix array, children before parents.

    ``lcp[i]`` belongs to entries i and i + 1; the scan keeps the open intervals on a stack.
    """
    stack: list[tuple[int, int]] = []
    for i, x in enumerate([*lcp, -1]):
        first = i
        while stack and stack[-1][0] > x:
            length, first = stack.pop()
            yield length, first, i
        if x >= 0 and (not stack or stack[-1][0] < x):
            stack.append((x, first))


def maximal_repeats(ahead: list[bytes], back: list[bytes], min_bytes: int) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """right, left, [(entry, its longest left extension)] of each interval whose repeats reach ``min_bytes``.

    ``ahead`` is sorted. ``left`` is the extension that all entries named share; left extensions are diverse there.
    """
    for right, lo, hi in intervals([common(a, b) for a, b in zip(ahead, ahead[1:])]):
        need = min_bytes - right
        if hi - lo == 1:
            length = common(back[lo], back[hi])
            if length >= need:
                yield right, length, [(lo, length), (hi, length)]
            continue
        order = sorted(range(lo, hi + 1), key=back.__getitem__)
        shared = [common(back[a], back[b]) for a, b in zip(order, order[1:])]
        group: list[tuple[int, int]] = []
        least = len(back[order[0]])
        for k, entry in enumerate(order):
            before, after = (shared[k - 1] if k else -1), (shared[k] if k < len(shared) else -1)
            if max(before, after) >= need:
                group.append((entry, max(before, after)))
                if before >= need:
                    least = min(least, before)
            if after < need and group:
                if len(group) > 1:
                    yield right, least, group
                group, least = [], min_bytes
            elif not k or before < need:
                least = min_bytes


COVER = "c1 bigint, c2 bigint, left bigint, right bigint"


def _bucket_rows(bucket: list[tuple], min_bytes: int) -> list[tuple]:
    """c1, c2, left, right: how far each entry of a bucket is covered. Entries that occur twice are covered anyway."""
    best: dict[int, int] = {}
    out = []
    for right, _, group in maximal_repeats([x[5] for x in bucket], [x[4] for x in bucket], min_bytes):
        for entry, left in group:
            if left > best.get(entry, -1) and bucket[entry][3] == 1:
                best[entry] = left
                out.append((*bucket[entry][1:3], left, right))
    return out


def _bucket_batches(min_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket: list[tuple] = []
        out: list[tuple] = []
        for batch in _slices(batches, 2048):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "c1", "c2", "n", "back", "ahead"))):
                if bucket and bucket[0][0] != row[0]:
                    out += _bucket_rows(bucket, min_bytes)
                    bucket = []
                bucket.append(row)
            if len(out) >= 5000:
                yield _batch(out, COVER)
                out = []
        out += _bucket_rows(bucket, min_bytes)
        if out:
            yield _batch(out, COVER)

    return run


def covered(docs: DataFrame, min_bytes: int = MIN_BYTES, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT, piece_bytes: int = PIECE, width: int = 1, save: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """f, r, spans (array of start, end) for the rows of ``docs`` (f, r, text) with repeated strings.

    For a ``width`` of ``WORD`` the texts' hashed words are searched. ``save`` writes work tables.
    """
    save = save or saved
    # Anchors keep 24 bits of their place among the pieces of a batch, of which the last may be as long as all before it.
    if 2 * piece_bytes + 3 * min_bytes > 1 << 24:
        raise ValueError(f"piece_bytes and min_bytes are too long: {piece_bytes}, {min_bytes}")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "f bigint, r bigint, pos bigint, left smallint, right smallint, gram bigint, c1 bigint, c2 bigint, k1 bigint, k2 bigint"
    anchors = save(docs.mapInArrow(_anchor_batches(min_bytes, gram, piece_bytes, width), schema), "suffix-anchors")
    # Aggregates are written out before they are joined, so that a join on a hot key can be split.
    grams = save(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "suffix-grams")
    found = save(anchors.join(grams, "gram", "left_semi").drop("gram"), "suffix-found")
    contexts = found.groupBy("c1", "c2").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("f", "r", "pos")).alias("rep"), *[F.min(c).cast("long").alias(c) for c in ("left", "right", "k1", "k2")]
    )
    contexts = save(contexts.select("c1", "c2", "n", "rep.*", "left", "right", "k1", "k2"), "suffix-contexts")
    covers = contexts.where("n > 1").select("c1", "c2", "left", "right")

    bands = F.array(*[F.struct(F.lit(lo * width).alias("lo"), F.lit((hi - 1) * width + 1).alias("hi"), F.col(k).alias("key")) for (lo, hi), k in zip(bands_of(min_bytes // width, gram // width), ("k1", "k2"))])
    keyed = contexts.select("c1", "c2", "n", "f", "r", "pos", F.explode(bands).alias("band")).where("band.key is not null")
    keyed = keyed.select("c1", "c2", "n", "f", "r", "pos", "band.lo", "band.hi", F.unhex(F.hex("band.key")).alias("key"))
    keyed = keyed.join(_sizes(keyed, bucket_limit, save), "key")
    at = keyed.groupBy("f", "r").agg(F.collect_list(F.struct("pos", "key", "lo", "hi", "large", "c1", "c2", "n")).alias("at"))
    packed = docs.mapInArrow(_packed, "f bigint, r bigint, zip binary")
    entries = save(packed.join(at, ["f", "r"]).select("zip", "at").mapInArrow(_context_batches(min_bytes, width), ENTRY), "suffix-entries")

    tree = ["key", "c1", "c2", "n", "back", "ahead"]
    trees, large, turn = entries.where("not large").select(tree), entries.where("large").select(tree), 0
    while not large.isEmpty():
        first = ("n", "c1", "c2") if turn % 2 == 0 else ("c1", "c2", "n")
        paths = save(large.groupBy("key").agg(F.max(F.struct(*first, "back", "ahead")).alias("path")), "suffix-paths")
        cut = save(large.join(paths, "key").mapInArrow(_path_batches(min_bytes), CUT), "suffix-cut")
        covers = covers.unionByName(cut.where("left is not null").select("c1", "c2", "left", "right"))
        cut = save(cut.join(_sizes(cut.where("key is not null"), bucket_limit, save), "key"), "suffix-subtrees")
        trees, large, turn = trees.unionByName(cut.where("not large").select(tree)), cut.where("large").select(tree), turn + 1
    trees = trees.repartition(n, "key").sortWithinPartitions("key", "ahead", "back").mapInArrow(_bucket_batches(min_bytes), COVER)
    # All covers of a context lie over its anchor, so together they are one stretch: the farthest to each side.
    covers = save(covers.unionByName(trees).groupBy("c1", "c2").agg(F.max("left").alias("l"), F.max("right").alias("k")), "suffix-covers")
    spans = found.join(covers, ["c1", "c2"]).select("f", "r", (F.col("pos") - F.col("l")).alias("start"), (F.col("pos") + F.col("k")).alias("end")).distinct()
    return spans.groupBy("f", "r").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _sizes(keyed: DataFrame, bucket_limit: int, save: Callable[[DataFrame, str], DataFrame]) -> DataFrame:
    """key, large: the buckets with two entries or more."""
    return save(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", (F.col("m") > bucket_limit).alias("large")), "suffix-sizes")


def passages(docs: DataFrame, min_words: int = MIN_WORDS, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT, piece_bytes: int = PIECE) -> DataFrame:
    """f, r, n_words_repeated: words in passages of ``min_words`` words that stand elsewhere too, for rows of ``docs`` that have any."""
    work: list[DataFrame] = []

    def save(df: DataFrame, name: str) -> DataFrame:
        work.append(saved(df, name))
        return work[-1]

    spans = covered(docs, min_words * WORD, gram, bucket_limit, piece_bytes, WORD, save)
    found = saved(spans.mapInArrow(_words_in, "f bigint, r bigint, n_words_repeated bigint"), "suffix-passages")
    # Nothing reads the work tables from here on; the strings of bytes need the room.
    for df in work:
        discarded(df)
    return found


def _words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        counts = []
        for spans in batch.column("spans").to_pylist():
            n = at = 0
            # Hashes of different words may agree in a few bytes at a passage's ends: whole words count.
            for s, e in sorted((-(-x["start"] // WORD), x["end"] // WORD) for x in spans):
                n += max(0, e - max(s, at))
                at = max(at, e)
            counts.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("f"), batch.column("r"), pa.array(counts, pa.int64())], ["f", "r", "n_words_repeated"])


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    unzip = zstandard.ZstdDecompressor()
    for batch in _slices(batches):
        out = []
        for z, spans in zip(batch.column("zip"), batch.column("spans").to_pylist()):
            text = unzip.decompress(z.as_py())
            kept, at, n_spans, removed = hashlib.sha256(), 0, 0, 0
            lo = hi = -1
            for s, e in [*sorted((x["start"], x["end"]) for x in spans or []), (len(text) + 1, 0)]:
                if s > hi:
                    if hi >= 0:
                        n_spans += 1
                        removed += hi - lo
                        kept.update(text[at:lo])
                        at = hi
                    lo, hi = s, e
                else:
                    hi = max(hi, e)
            kept.update(text[at:])
            out.append((len(text), removed, n_spans, kept.hexdigest()))
        names = [c for c in batch.schema.names if c not in ("zip", "spans")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], [*names, "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, gram: int = GRAM, bucket_limit: int = BUCKET_LIMIT, piece_bytes: int = PIECE, min_words: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for each row of ``docs``; with ``min_words`` also n_words_repeated."""
    at = located(docs, doc_id=id_col, text=text_col)
    rows = at.select("doc_id", F.col("text").cast("string").alias("text"), F.xxhash64(FILE).alias("f"), F.col(ROW).alias("r"))
    words = min_words and passages(rows.select("f", "r", "text"), min_words, gram, bucket_limit, piece_bytes)
    spans = saved(covered(rows.select("f", "r", "text"), min_bytes, gram, bucket_limit, piece_bytes), "suffix-spans")
    kind = rows.schema["doc_id"].dataType.simpleString()
    packed = rows.mapInArrow(_packed, f"doc_id {kind}, f bigint, r bigint, zip binary")
    joined = packed.join(spans, ["f", "r"], "left").select("doc_id", "zip", "spans")
    out = f"doc_id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    if not min_words:
        return joined.mapInArrow(_without, out)
    joined = packed.join(spans, ["f", "r"], "left").join(words, ["f", "r"], "left")
    joined = joined.select("doc_id", F.coalesce("n_words_repeated", F.lit(0)).alias("n_words_repeated"), "zip", "spans").mapInArrow(_without, f"doc_id {kind}, n_words_repeated bigint" + out.removeprefix(f"doc_id {kind}"))
    return joined.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_words_repeated")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), min_words=MIN_WORDS)
