"""Spans of regular expressions as columns: code point offsets, from built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:bigint,end:bigint,kind:string,value:string>>"
#: Matches of one text are added up in pieces of this size, and pieces in blocks of as many, so that long texts stay linear.
PIECE = 64
#: Code points of a piece of a text that contexts are read from.
CHUNK = 512


def empty_spans() -> Column:
    return F.from_json(F.lit("[]"), SPAN)


def let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of ``value``, which is worked out once: what a lambda takes from outside, it works out for each element."""
    return F.transform(F.array(value), then)[0]


def find_spans(text: Column, pattern: str, kind: str, group: int = 0) -> Column:
    """Leftmost non-overlapping matches as structs start, end, kind, value; ``group`` gives the value.

    What lies between matches is had by splitting; offsets are the running sums of the lengths, made of sums of pieces of
    the matches and of blocks of the pieces. (A fold that appends would copy all that it has at each step.)
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    # The last gap has no match.
    both = F.filter(
        F.zip_with(found, F.split(text, pattern, -1), lambda m, b: F.struct(m.alias("m"), F.char_length(b).cast("bigint").alias("gap"), F.char_length(m).cast("bigint").alias("size"))),
        lambda x: x["m"].isNotNull(),
    )
    zero = F.lit(0).cast("bigint")
    total = lambda sizes, first, n: F.aggregate(F.slice(sizes, first + 1, n), zero, lambda acc, x: acc + x)
    ranks = lambda xs: F.sequence(F.lit(0), F.ceil(F.size(xs) / PIECE).cast("int") - 1)
    sums = lambda sizes: F.transform(ranks(sizes), lambda j: total(sizes, j * PIECE, PIECE))

    def spans(b: Column, widths: Column, pieces: Column, blocks: Column) -> Column:
        block = lambda j: F.floor(j / PIECE).cast("int")
        bases = F.transform(ranks(b), lambda j: total(blocks, F.lit(0), block(j)) + total(pieces, block(j) * PIECE, j % PIECE))
        one = lambda x, start: F.struct(start.alias("start"), (start + x["size"]).alias("end"), F.lit(kind).alias("kind"), x["m"].alias("value"))
        of = lambda base, j: F.transform(F.slice(b, j * PIECE + 1, PIECE), lambda x, i: let(base + total(widths, j * PIECE, i) + x["gap"], lambda start: one(x, start)))
        return F.flatten(F.transform(bases, of))

    def found_spans(b: Column) -> Column:
        widths = F.transform(b, lambda x: x["gap"] + x["size"])
        deep = let(widths, lambda w: let(sums(w), lambda p: let(sums(p), lambda q: spans(b, w, p, q))))
        return F.when(F.size(b) > 0, deep).otherwise(empty_spans())

    out = let(both, found_spans)
    return F.transform(out, lambda s: s.withField("value", F.regexp_extract(s["value"], pattern, group))) if group else out


def chunks(text: Column) -> Column:
    """``text`` in pieces of CHUNK code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def around(pieces: Column, start: Column, end: Column, size: int) -> tuple[Column, Column]:
    """The ``size`` characters, CHUNK at most, on both sides of a span of the text that ``pieces`` make up."""
    two = lambda i: F.concat(F.coalesce(F.get(pieces, i), F.lit("")), F.coalesce(F.get(pieces, i + 1), F.lit("")))
    before = F.floor((F.greatest(start - size, F.lit(0))) / CHUNK).cast("int")
    after = F.floor(end / CHUNK).cast("int")
    left = F.substring(two(before), (F.greatest(start - size, F.lit(0)) - before * CHUNK + 1).cast("int"), F.least(start, F.lit(size)).cast("int"))
    return left, F.substring(two(after), (end - after * CHUNK + 1).cast("int"), F.lit(size))


def joined(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end by start, then end of the list ``kinds``, comma-joined."""
    place = F.create_map(*[x for i, k in enumerate(kinds) for x in (F.lit(k), F.lit(i))])
    rows = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.coalesce(F.try_element_at(place, s["kind"]), F.lit(len(kinds))).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(rows, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def number_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
