"""Span searches take time linear in the length of a text, and contexts are right beyond a piece's end."""

from __future__ import annotations

import re
import time

from pyspark.sql import functions as F

from candlewick.llm import pii, secrets
from candlewick.llm.spans import CHUNK, chunks, find_spans, let


def took(run) -> float:
    best = []
    for _ in range(2):
        start = time.time()
        run()
        best.append(time.time() - start)
    return min(best)


def test_secret_spans_are_linear(spark):
    def run(n):
        df = spark.createDataFrame([("token = abcdefghijklm x\n" * n,)], "text string")
        assert df.select(F.size(find_spans(F.col("text"), secrets.ASSIGN, "assign", 2))).first()[0] == n

    assert took(lambda: run(80_000)) <= 2.3 * took(lambda: run(40_000))


def test_pii_spans_are_linear(spark):
    """Base spans and candidates with their contexts, through the join of both."""
    line = "10.0.{}.7 GET by ann{}@post.org tel +1 202 555 0{:03d}, 4111 1111 1111 1111 12\n"

    def run(n):
        text = "".join(line.format(i % 256, i, i % 1000) for i in range(n))
        df = spark.createDataFrame([(1, text)], "row int, text string")
        found = df.select("row", pii.base_spans(F.col("text")).alias("base"), pii.with_context(F.col("text"), pii.candidate_spans(F.col("text"))).alias("other"))
        assert pii.candidates(found).where("not inside").count() >= n

    run(100)
    assert took(lambda: run(16_000)) <= 2.3 * took(lambda: run(8_000))


def test_spans_and_contexts_equal_regular_expressions(spark):
    texts = [("ü😀" * (k % 700) + f"a{k}b" + "x" * (3 * k) + f"a{k}b ") * (k % 5 + 1) for k in range(0, 900, 13)] + ["", "a1b", "none", "😀" * CHUNK + "a1b" + "ß" * CHUNK + "a2b"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string")
    spans = pii.with_context(F.col("text"), find_spans(F.col("text"), "a[0-9]+b", "k"))
    for i, t, found in df.select("i", "text", spans).collect():
        want = [(m.start(), m.end(), "k", m.group(), t[max(m.start() - 40, 0) : m.start()], t[m.end() : m.end() + 40]) for m in re.finditer("a[0-9]+b", t)]
        assert [tuple(s) for s in found] == want
    assert all("".join(c) == t for t, c in df.select("text", let(chunks(F.col("text")), lambda c: c)).collect())


def test_overlaps_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    base, other = [], []
    for row in range(30):
        cuts = np.sort(rng.choice(4000, 60, replace=False))
        base.append([(int(a), int(b), "card", "v") for a, b in zip(cuts[::2], cuts[1::2])])
        starts = rng.integers(0, 4000, 80)
        other.append([(int(a), int(a + rng.integers(1, 200)), "card", "v", "l", "r") for a in starts] * 2)
    span = "start bigint, end bigint, kind string, value string"
    found = spark.createDataFrame(list(zip(range(30), base, other)), f"row int, base array<struct<{span.replace(' b', ':b').replace(' s', ':s')}>>, other array<struct<{span.replace(' b', ':b').replace(' s', ':s')},left:string,right:string>>")
    got = pii.candidates(found)
    want = {(row, s[0], s[1], any(b[0] < s[1] and s[0] < b[1] for b in base[row]), any(b[0] <= s[0] and s[1] <= b[1] for b in base[row])) for row in range(30) for s in other[row]}
    rows = [(r.row, r.span.start, r.span.end, r.span.in_base, r.inside) for r in got.collect()]
    assert len(rows) == len(want) and set(rows) == want
    chance = {(row, a, b): float(rng.integers(1, 9) / 10) for row, a, b, *_ in rows}
    good = spark.createDataFrame([(r, (a, b, "card", "v"), c) for (r, a, b), c in chance.items()], "row int, span struct<start:bigint,end:bigint,kind:string,value:string>, chance double")
    kept = {(r.row, s.start, s.end) for r in pii.best(good).collect() for s in r.added}
    rank = lambda k: (-chance[k], k[1], -k[2])
    assert kept == {k for k in chance if not any(q[0] == k[0] and q[1] < k[2] and k[1] < q[2] and rank(q) < rank(k) for q in chance)}


def test_further_formats_have_no_caps(spark):
    values = {
        "url_login": "x" * 20 + "+ssh://" + "u" * 90 + ":" + "p" * 300 + "@host 1.postgres://me:longenough@db",
        "private_key": "-----BEGIN A VERY LONG LABEL OF MANY WORDS PRIVATE KEY-----" + "Q" * 5000,
        "none": "http://host:8080/a@b https://user:short@host " + "a.b-c+d " * 3000,
    }
    rows = spark.createDataFrame(list(values.items()), "doc_id string, text string").withColumn("source", F.lit("s"))
    found = {r.doc_id: [(s.kind, s.value) for s in r.added] for r in secrets.scan(rows).collect()}
    assert found == {"url_login": [("url_login", "p" * 300), ("url_login", "longenough")], "private_key": [("private_key", "Q" * 5000)], "none": []}
