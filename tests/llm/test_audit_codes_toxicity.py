"""Filter audit, vector codes and toxicity against brute force, on small tables with nulls, ties and clashing names."""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from candlewick.llm import filter_audit, registry, toxicity, vector_codes

DOCS = "doc_id bigint, text string, lang string, source string, mask int, digest string, part string, quality int, n bigint, size int, toxic int"
LABELS = "doc_id bigint, quality int, toxic int, text string, mask int"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, "s", 1, "d", "p", 5, 7, 3, 9) for i, t, lang in rows], DOCS)


def words(seed, n, vocabulary=60):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, vocabulary, n))


def audited(rows, labels):
    """Every order, filter by filter, as the contract says it."""
    ids = [i for i, _, _ in rows if i is not None]
    masks = []
    for i, t, lang in rows:
        t = t or ""
        ws = re.findall(r"[^\x20\x09-\x0D]+", t)
        same = [j for j in ids if i is not None and j < i and any(k == j and (u or "") == t for k, u, _ in rows)]
        bad = {"A": len(ws) < 200, "B": 100 * len(set(ws)) < 50 * len(ws), "C": 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": bool(same)}
        good, toxic = (any(d == i and x[k] == 1 for d, *x in labels) if i is not None else False for k in (0, 1))
        masks.append((lang or "", {f for f in bad if bad[f]}, good, toxic))
    out = set()
    for part in {m[0] for m in masks}:
        shapley, found = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = [m for m in masks if m[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here, left = [m for m in left if f in m[1]], [m for m in left if f not in m[1]]
                shapley[f] += len(here)
                found.append((order, step, f, len(left), len(here), sum(f in m[1] for m in gone), sum(m[0] == part and m[1] == {f} for m in masks), sum(m[2] for m in here), sum(m[3] for m in here)))
                gone += here
        out |= {(part, o, s, *rest, shapley[f]) for o, s, f, *rest in found}
    return out


def test_filter_audit_equals_brute_force(spark):
    long = " ".join(f"x{i}" for i in range(300))
    rows = [(1, long, "en"), (2, long, "en"), (2, long, "en"), (3, long, None), (None, long, ""), (4, None, "en"), (5, "", "de"), (5, "", "de"), (0, "same $ text", "de"), (7, "same $ text", "en"), (8, long.upper(), "en"), (9, long + " #", "de")]
    rows += [(10 + k, words(k, 250), "fr") for k in range(4)] + [(20, "Ünïcödé ÄÖÜ    word " * 60, "fr"), (21, "tab\tnew\nline\x0bvt\x0cff\rcr " * 40, "fr")]
    labels = [(1, 1, 0), (1, 0, 1), (2, 1, None), (9, None, 1), (None, 1, 1), (99, 1, 1), (20, 1, 1)]
    got = filter_audit.audit(table(spark, rows), spark.createDataFrame([(*r, "x", 0) for r in labels], LABELS))
    assert {tuple(r) for r in got.select("part", "filter_order", "step", *filter_audit.COUNTS).collect()} == audited(rows, labels)
    assert got.count() == 4 * 600


def test_filter_audit_of_nothing(spark):
    none = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(table(spark, []), none).count() == 0
    assert filter_audit.audit(table(spark, [(None, None, None)]), none).count() == 600


@pytest.mark.parametrize("window", [1, 7, 64, 1 << 20])
@pytest.mark.parametrize("values", [filter_audit.VALUES, np.zeros(256, np.uint64)])
def test_scanner_counts(window, values):
    """With values of zero all words share a hash, so each text falls back to the set of its words."""
    rng = np.random.default_rng(3)
    texts = ["", "a", " ", "a a", "", "b", "ß b ß", "x" * 50 + " " + "x" * 50, *["".join(rng.choice(list("ab AB#\té\n"), n)) for n in rng.integers(0, 200, 60)]]
    parts = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, parts)])
    got = filter_audit.Scanner(window, values).counts(np.frombuffer(b"".join(parts), np.uint8), offsets)
    want = [re.findall(r"[^\x20\x09-\x0D]+", t) for t in texts]
    assert got["words"].tolist() == [len(w) for w in want]
    assert got["distinct"].tolist() == [len(set(w)) for w in want]
    assert got["capitals"].tolist() == [len(re.findall("[A-Z]", t)) for t in texts]
    assert got["symbols"].tolist() == [t.count("#") for t in texts]
    assert got["points"].tolist() == [len(t) for t in texts]


def coded(rows, entries=64, rounds=2):
    """Product quantisation entry by entry, in Python's integers."""
    rows = [(i, label, [int(np.floor(256 * x)) for x in v]) for i, v, label in rows]
    rows.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    w = len(rows[0][2]) // 16
    parts = [[r[2][k * w : k * w + w] for k in range(16)] for r in rows]
    books = [[list(p[k]) for p in parts[:entries]] for k in range(16)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), j) for j, e in enumerate(book))
    for _ in range(rounds):
        for k in range(16):
            own = [[] for _ in books[k]]
            for p in parts:
                own[near(p[k], books[k])[1]].append(p[k])
            books[k] = [[sum(c) // len(o) for c in zip(*o)] if o else e for o, e in zip(own, books[k])]
    found = [[near(p[k], books[k]) for k in range(16)] for p in parts]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(r[0], r[1], "".join(f"{j:02x}" for _, j in f), sum(d for d, _ in f)) for r, f in zip(rows, found)], digest


@pytest.mark.parametrize("n", [1, 5, 64, 300])
def test_vector_codes_equal_brute_force(spark, n):
    rng = np.random.default_rng(n)
    # Few values, so that many entries are equally near and some are equal.
    rows = [(int(i), (rng.integers(-3, 4, 32) / 512 + (i % 3)).tolist(), int(i % 4) if i % 5 else None) for i in rng.permutation(n)]
    rows += [(rows[0][0], rows[-1][1], 2), (None, rows[0][1], 1)]
    bad = [(-1, None, 1), (-2, [], 1), (-3, [float("nan")] * 32, 1), (-4, [float("inf"), *[0.0] * 31], 1), (-5, [None, *[0.0] * 31], 1), (10_000, [0.0] * 16, 1)]
    frame = spark.createDataFrame([(i, v, label, "x", "y") for i, v, label in rows + bad], "vec_id bigint, embedding array<float>, label int, code string, v string").repartition(5)
    found, books = vector_codes.compress(frame)
    want, digest = coded(rows)
    assert sorted(map(repr, found.collect())) == sorted(map(repr, (vector_codes_row(*w) for w in want)))
    assert books.digest() == digest


def vector_codes_row(vec_id, label, code, error):
    from pyspark.sql import Row

    return Row(vec_id=vec_id, label=label, code=code, error=error)


def test_vector_codes_of_nothing(spark):
    found, books = vector_codes.compress(spark.createDataFrame([(1, None, 1)], "vec_id bigint, embedding array<float>, label int"))
    assert found.count() == 0 and books.size == 0


def test_annulus_prunes_and_is_exact():
    rng = np.random.default_rng(1)
    for spread, most in ((np.ones(64), 1.1), (np.geomspace(1, 1000, 64), 0.6)):
        entries = (rng.integers(-60, 60, (64, 4)) * spread[:, None]).astype(np.int64)
        parts = (rng.integers(-60, 60, (5000, 4)) * rng.choice(spread, 5000)[:, None]).astype(np.int64)
        annuli = vector_codes.Annuli(entries)
        index, far = annuli.nearest(parts)
        every = ((parts[:, None] - entries[None]) ** 2).sum(2)
        assert (far == every.min(1)).all() and (index == every.argmin(1)).all()
        assert annuli.evaluated < most * every.size
    with pytest.raises(ValueError):
        annuli.nearest(np.full((1, 4), 1 << 40))


def test_vector_codes_and_audit_equal_sql(spark, duck, sf):
    for name in ("op12_filter_audit", "op13_vector_codes"):
        got, want = registry.queries()[name](spark, sf).toPandas(), duck.sql(registry.oracle_sql()[name]).df()[:]
        want = want[got.columns]
        keys = list(got.columns[:3])
        assert got.sort_values(keys).values.tolist() == want.sort_values(keys).values.tolist()


INSULTS = ["stupid", "worthless", "disgusting", "pathetic", "moronic"]


def rants(seed, n):
    """Texts of which each fourth has insults; those of the last quarter are misspelt in ways that none of the others is."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        text = words(seed * n + k, int(rng.integers(20, 120)), 500).split()
        if k % 4 == 0:
            for _ in range(len(text) // 15 + 1):
                insult = INSULTS[rng.integers(len(INSULTS))]
                if k >= 3 * n // 4:
                    at = int(rng.integers(1, len(insult) - 1))
                    insult = insult[:at] + insult[at] * 2 + insult[at + 1 :]
                text.insert(int(rng.integers(len(text))), insult.title())
        out.append((k, " ".join(text), "en"))
    return out


def test_toxicity_finds_unseen_misspellings(spark):
    rows = rants(1, 800)
    rows += [(900, None, "en"), (901, "", "en"), (902, " \n?!", "en"), (None, "you stupid, pathetic, worthless moronic thing", "en"), (903, words(9, 200_000) + " stupid", "en"), (3, rows[3][1], "en")]
    labels = spark.createDataFrame([(k, 1, int(k % 4 == 0), "x", 0) for k in range(600)] + [(901, 1, None, "x", 0), (None, 1, 1, "x", 0), (5, 1, 7, "x", 0), (70_000, 1, 1, "x", 0)], LABELS)
    got = toxicity.detect(table(spark, rows), labels)
    found = {(r.doc_id, i): r for i, r in enumerate(got.collect())}
    assert len(found) == len(rows) and got.columns == ["doc_id", "held_out", "score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in found.values())
    new = [r for (k, _), r in found.items() if k is not None and 600 <= k < 800]
    assert np.mean([r.predicted == (r.doc_id % 4 == 0) for r in new]) > 0.95
    empty = {r.score for (k, _), r in found.items() if k in (900, 901, 902)}
    assert len(empty) == 1
    by = [r.score for (k, _), r in found.items() if k == 3]
    assert len(by) == 2 and by[0] == by[1]
    assert next(r for (k, _), r in found.items() if k is None).predicted == 1
    again = toxicity.detect(table(spark, rows).repartition(7), labels.repartition(3))
    assert {(r.doc_id, round(r.score, 12)) for r in again.collect()} == {(r.doc_id, round(r.score, 12)) for r in found.values()}


def test_toxicity_learns_from_its_fold_alone(spark):
    rows, labels = rants(2, 200), [(k, 1, int(k % 4 == 0), "x", 0) for k in range(200)]
    held = toxicity.fold(F.col("doc_id")) == 0
    flipped = spark.createDataFrame(labels, LABELS).withColumn("toxic", F.when(held, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    one, two = (toxicity.detect(table(spark, rows), x).orderBy("doc_id").collect() for x in (spark.createDataFrame(labels, LABELS), flipped))
    assert one == two and 20 < sum(r.held_out for r in one) < 60


def test_toxicity_without_labels(spark):
    none = spark.createDataFrame([], LABELS)
    assert toxicity.detect(table(spark, []), none).count() == 0
    assert [r.score for r in toxicity.detect(table(spark, [(1, "a", "en"), (2, None, "en")]), none).collect()] == [0, 0]
    ones = spark.createDataFrame([(k, 1, 1, "x", 0) for k in range(9)], LABELS)
    assert {r.score for r in toxicity.detect(table(spark, [(k, "a", "en") for k in range(9)]), ones).collect()} == {1.0}


def test_word_scores_are_the_trained_model():
    texts = ["so stupid a thing", "nice thing", "stupid", "very nice day", "a b c"] * 4
    model = toxicity.Model.train(texts, [int("stupid" in t) for t in texts], 0.4)
    row, bucket, times = toxicity.features(texts)
    direct = np.bincount(row, model.weights[bucket] * times) / np.bincount(row, times) + model.bias
    assert np.allclose(model.scorer()(texts), 1 / (1 + np.exp(-direct)))
    assert toxicity.word_buckets([])[0].size == 0 and toxicity.features(["", "?"])[0].size == 0


def test_toxicity_held_out_on_the_tables(spark, sf):
    """Area under the curve on held-out documents of the larger table; a tenth of its labels have no marked word."""
    sf = sf.replace("0.001", "0.1")
    found = registry.queries()["op11_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").select("score", "toxic").toPandas()
    ranks = found["score"].rank()
    y = found["toxic"] == 1
    area = (ranks[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert area > 0.9
