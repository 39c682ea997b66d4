"""Toxicity by a bag of subword embeddings, averaged into a linear softmax and trained jointly in numpy.

A text's features are its words (maximal runs of letters, digits and underscores, in lower case) and the n-grams of each
word, its ends marked, hashed into ``BUCKETS`` embeddings. Their average goes through a linear layer into a softmax over
the two labels; embeddings and layer are trained together, by mini-batches. A misspelling that
was never seen shares most of its n-grams with the word that was, and so most of its score.

As everything after the embeddings is linear, a trained bucket has one number: how far it moves the logit. A word has the
sum over its buckets, and a text the mean over all of its features, so scoring reads each text once and whole, long texts
too, and what tasks are sent is ``BUCKETS`` numbers, whatever the input's size.

Training reads ``PER_LABEL`` labelled documents of each label at most, those of the least hashes of their ids among the
ones of 1 to ``TRAIN_CHARS`` characters: a bounded sample, the same however the table is dealt out. The labels weigh the
same in training; the prior of the two labels among all labelled training documents is then added to the logit.

Labels other than 0 and 1 and labels without a document are no labels; a document with several is toxic if one says so. A
null doc_id is in no fold and is scored. Null and empty texts, and texts without a word, have the prior's score; without
labels, or with one label alone, all scores are the share of label 1, 0 for none. Repeated rows get equal scores. An empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, saved, table

BUCKETS, DIMS = 1 << 17, 12
#: Lengths of n-grams in characters, with the marks of a word's ends.
LEAST_GRAM, MOST_GRAM = 3, 6
PER_LABEL, TRAIN_CHARS = 2000, 50_000
EPOCHS, BATCH, RATE, SEED = 20, 64, 1.0, 11
#: Words that a task remembers.
WORDS_HELD = 200_000
WORD = re.compile(r"\w+")


def word_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the features of all words, one word after the other, and how many features each word has."""
    marked = [f"<{w}>" for w in words]
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in marked], np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)
    of = np.repeat(np.arange(len(words)), sizes)
    hashed, owner = [], []
    with np.errstate(over="ignore"):
        mixed = (codes + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        run = np.zeros(len(codes), np.uint64)
        for n in range(1, MOST_GRAM + 1):
            # The hash of n characters from that of n - 1.
            inside = np.arange(len(codes)) + n <= ends
            run[inside] = (run[inside] ^ mixed[np.flatnonzero(inside) + n - 1]) * np.uint64(0xD6E8FEB86659FD93)
            run ^= run >> np.uint64(29)
            if n >= LEAST_GRAM:
                hashed.append(run[inside])
                owner.append(of[inside])
        # The word itself: a sum over its characters and their places.
        heads = np.cumsum(sizes) - sizes
        place = (np.arange(len(codes)) - heads[of] + 1).astype(np.uint64) if len(codes) else codes
        whole = np.add.reduceat(mixed * (place * np.uint64(0xA0761D6478BD642F) | np.uint64(1)), heads) if len(codes) else codes
        hashed.append(whole ^ (whole >> np.uint64(31)))
        owner.append(np.arange(len(words)))
        hashed, owner = np.concatenate(hashed), np.concatenate(owner)
        bucket = ((hashed * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
    order = np.argsort(owner, kind="stable")
    return bucket[order], np.bincount(owner, minlength=len(words))


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, bucket and count of each text's features."""
    counted = [Counter(WORD.findall(t.lower())) for t in texts]
    words = sorted(set().union(*counted)) if counted else []
    if not words:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    buckets, sizes = word_buckets(words)
    heads, place = np.cumsum(sizes) - sizes, {w: i for i, w in enumerate(words)}
    row = np.repeat(np.arange(len(texts)), [len(c) for c in counted])
    word = np.array([place[w] for c in counted for w in c], np.int64)
    times = np.array([n for c in counted for n in c.values()], np.int64)
    each = sizes[word]
    at = np.repeat(heads[word], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    key = np.repeat(row, each) * BUCKETS + buckets[at]
    key, inverse = np.unique(key, return_inverse=True)
    return key // BUCKETS, key % BUCKETS, np.bincount(inverse, np.repeat(times, each)).astype(np.int64)


class Model:
    """What each bucket adds to the logit of label 1, and the logit of a text without features."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    @staticmethod
    def constant(share: float) -> Model:
        return Model(np.zeros(0), np.inf if share >= 1 else -np.inf if share <= 0 else float(np.log(share / (1 - share))))

    @staticmethod
    def train(texts: list[str], labels: list[int], share: float, epochs: int = EPOCHS, rate: float = RATE) -> Model:
        """Embeddings and softmax together; ``share`` is that of label 1 among all labelled documents."""
        y = np.array(labels, np.int64)
        if len(set(labels)) < 2:
            return Model.constant(share)
        rng = np.random.default_rng(SEED)
        embed = rng.uniform(-1 / DIMS, 1 / DIMS, (BUCKETS, DIMS)).astype(np.float32)
        # Both labels weigh the same; steps shrink as slopes add up, alike for rare buckets and frequent ones.
        weight, seen = (0.5 * len(y) / np.bincount(y, minlength=2)).astype(np.float32), 1e-12
        layer, bias = np.zeros((DIMS, 2), np.float32), np.zeros(2, np.float32)
        layer_seen, bias_seen = np.full((DIMS, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)
        order = rng.permutation(len(texts))
        batches = []
        for at in range(0, len(order), BATCH):
            rows = order[at : at + BATCH]
            row, bucket, times = features([texts[i] for i in rows])
            batches.append((rows, row.astype(np.int32), bucket.astype(np.int32), times.astype(np.float32)))
        for _ in range(epochs):
            for b in rng.permutation(len(batches)):
                rows, row, bucket, times = batches[b]
                if not len(row):
                    continue
                used, place = np.unique(bucket, return_inverse=True)
                bag = np.zeros((len(rows), len(used)), np.float32)
                bag[row, place] = times
                bag /= np.maximum(bag.sum(1, keepdims=True), 1)
                mean = bag @ embed[used]
                logits = mean @ layer + bias
                p = np.exp(logits - logits.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(rows)), y[rows]] -= 1
                p *= weight[y[rows]][:, None]
                to_mean = p @ layer.T
                for value, held, slope in ((layer, layer_seen, mean.T @ p / len(rows)), (bias, bias_seen, p.mean(0))):
                    held += slope**2
                    value -= rate * slope / np.sqrt(held)
                slope = bag.T @ to_mean
                seen += float((slope**2).mean())
                embed[used] -= rate * slope / np.float32(seen**0.5)
        prior = np.log(share / (1 - share))
        return Model((embed @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0] + prior))

    def scorer(self):
        held: dict[str, tuple[float, int]] = {}

        def score(texts: list[str | None]) -> np.ndarray:
            found = []
            for t in texts:
                counted = Counter(WORD.findall(t.lower())) if t and len(self.weights) else {}
                if len(held) > WORDS_HELD:
                    held.clear()
                new = [w for w in counted if w not in held]
                if new:
                    buckets, sizes = word_buckets(new)
                    held.update(zip(new, zip(np.add.reduceat(self.weights[buckets], np.cumsum(sizes) - sizes).tolist(), sizes.tolist())))
                total = n = 0
                for w, times in counted.items():
                    s, size = held[w]
                    total, n = total + times * s, n + times * size
                found.append(total / n if n else 0.0)
            with np.errstate(over="ignore"):
                return 1 / (1 + np.exp(-(np.array(found, float) + self.bias)))

        return score


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    """A model from the labelled documents outside the held-out fold. ``docs`` has doc_id and text."""
    y = labels.select(field(labels, "doc_id").alias("doc_id"), field(labels, "toxic").alias("toxic")).where(F.col("toxic").isin(0, 1)).where(fold(F.col("doc_id")) != 0)
    size = F.char_length("text")
    known = docs.where(size > 0).select("doc_id", size.alias("size")).join(y.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").distinct()
    known = saved(known, "toxicity-labelled")
    share, n = known.agg(F.coalesce(F.avg("toxic"), F.lit(0.0)), F.count(F.lit(1))).first()
    if not n or share in (0.0, 1.0):
        return Model.constant(share)
    short = known.where(F.col("size") <= TRAIN_CHARS)
    # per_label ids of each label, and their texts.
    picked = [short.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label) for k in (0, 1)]
    picked = saved(picked[0].union(picked[1]).select("doc_id", "toxic"), "toxicity-picked")
    rows = docs.where(size.between(1, TRAIN_CHARS)).join(F.broadcast(picked), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).toArrow().sort_by("doc_id")
    return Model.train(rows["text"].to_pylist(), rows["toxic"].to_pylist(), share)


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.scorer()
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score(batch.column("text").to_pylist()))], ["doc_id", "score"])

    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")


def detect(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each row."""
    rows = docs.select(field(docs, id_col).alias("doc_id"), field(docs, text_col).cast("string").alias("text"))
    out = scores(rows, fit(rows, labels))
    return out.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
