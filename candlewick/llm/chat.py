"""Chat formatting by perspective rotation.

Every participant of a conversation is put in the assistant's place once: the dialogue is rendered with that speaker's
turns as assistant and every other speaker as a named user, and a mask marks the assistant's text for the loss.
``rotate`` gives a row for each conversation and participant, with all turns. A view is one value, so it is built in one
task, whose memory is that of the conversation. ``rotate_whole`` is for conversations too long for that: it cuts by the
turn's place among its conversation's rows, counted over sorted ranges, so every part is a bounded group; it repeats the
earlier system turns at the head of each part and says how the parts join to the whole view.

Turns stand in the order of their number, then role and text; a null number comes first. A null role speaks as
``unknown``; null text is empty. A system role is rendered as such in every view and takes no place of its own. What looks
like a mark in a role or a text gets a backslash (``<|`` is written ``<\\|``, and that ``<\\\\|``), so that no text
forges a turn and the text can be had back; line breaks in a role are written as blanks.
Repeated rows are repeated turns. Conversations of system turns alone, and empty tables, give no rows. Extra columns
are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import FILE, ROW, located, saved, table

PART_TURNS = 64
SYSTEM = "system"
UNKNOWN = "unknown"
# The marks of the rendering.
START, END = "<|start|>", "<|end|>\n"


def _head(role: Column, view: Column) -> Column:
    return F.concat(F.lit(START), F.when(role == view, F.lit("assistant")).when(role == SYSTEM, F.lit(SYSTEM)).otherwise(F.concat(F.lit("user name="), role)), F.lit("\n"))


def _plain(text: Column) -> Column:
    """Text in which no mark can stand."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def _columns() -> list[Column]:
    role = F.regexp_replace(_plain(F.coalesce(F.col("role").cast("string"), F.lit(UNKNOWN))), "[\r\n]", " ")
    text = _plain(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return [F.col("conv_id"), F.col("turn").cast("bigint").alias("turn"), role.alias("role"), text.alias("text")]


def rotate(turns: DataFrame) -> DataFrame:
    """conv_id, participant, n_turns, text, mask, n_masked for each conversation and participant.

    ``mask`` is an array of start and end (code points, end exclusive) of the assistant's text in ``text``.
    """
    rows = turns.select(*_columns())
    whole = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    speakers = F.array_distinct(F.filter(F.transform("turns", lambda t: t["role"]), lambda role: role != SYSTEM))
    return _rendered(whole.withColumn("participant", F.explode(speakers)), "turns", "conv_id", "participant", F.size("turns").cast("bigint").alias("n_turns"))


def _rendered(views: DataFrame, turns: str, *cols: str | Column) -> DataFrame:
    """``cols``, text, mask, n_masked of each view's ``turns``."""
    view = F.col("participant")
    pieces = F.transform(turns, lambda t: F.struct(_head(t["role"], view).alias("head"), t["text"].alias("body"), (t["role"] == view).alias("own")))
    views = views.withColumn("pieces", pieces)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.from_json(F.lit("[]"), "array<struct<start:bigint,end:bigint>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        lo = acc["at"] + F.char_length(p["head"])
        hi = lo + F.char_length(p["body"])
        return F.struct((hi + len(END)).alias("at"), F.when(p["own"], F.array_append(acc["spans"], F.struct(lo.alias("start"), hi.alias("end")))).otherwise(acc["spans"]).alias("spans"))

    mask = F.aggregate("pieces", start, step, lambda acc: acc["spans"])
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    out = views.select(*cols, text.alias("text"), mask.alias("mask"))
    return out.withColumn("n_masked", F.aggregate("mask", F.lit(0).cast("bigint"), lambda acc, s: acc + s["end"] - s["start"]))


def _placed(turns: DataFrame) -> DataFrame:
    """no_conv, conv_key, conv_id, place (from 0), n (rows of the conversation), role, text.

    Rows are dealt out by ranges of their whole order, the locator last, so that no key makes a range large; a row's
    place is its place in the range plus the rows of its conversation in the ranges before.
    """
    spark = turns.sparkSession
    rows = located(turns, conv_id="conv_id", turn="turn", role="role", text="text").select(*_columns(), FILE, ROW)
    rows = rows.withColumn("no_conv", F.col("conv_id").isNull()).withColumn("conv_key", F.coalesce(F.col("conv_id").cast("string"), F.lit("")))
    order = ["no_conv", "conv_key", "turn", "role", "text", FILE, ROW]
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
    dealt = saved(dealt.withColumn("at", F.monotonically_increasing_id()).drop("turn", FILE, ROW), "chat-order").withColumn("range", F.shiftright("at", 33))
    key = ["no_conv", "conv_key"]
    counts = dealt.groupBy(*key, "range").agg(F.count(F.lit(1)).alias("here"), F.min("at").alias("first"))
    by = Window.partitionBy(*key)
    before = F.coalesce(F.sum("here").over(by.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*key, "range", (before - F.col("first")).alias("shift"), F.sum("here").over(by).alias("n"))
    return dealt.join(counts, [*key, "range"]).select(*key, "conv_id", (F.col("at") + F.col("shift")).alias("place"), "n", "role", "text")


def rotate_whole(turns: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """conv_id, participant, part, n_parts, first_turn, n_turns, carried, text, mask, n_masked for each conversation, participant and part.

    Parts are numbered from 0 to ``n_parts`` - 1 and each starts at the turn in place ``first_turn``. The first
    ``carried`` code points of ``text`` repeat all system turns before the part: the whole view is the texts without
    them, joined by part. ``n_turns`` has no repeated turns. A row's size is that of the part and of these system turns.
    """
    rows, key = saved(_placed(turns), "chat-places"), ["no_conv", "conv_key"]
    part = F.floor(F.col("place") / part_turns).cast("bigint")
    parts = rows.groupBy(*key, "conv_id", part.alias("part")).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("turns"), F.max("n").alias("n"))
    told = rows.where((F.col("role") == SYSTEM) & (F.col("n") > part_turns)).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", "role", "text"))).alias("told"))
    speakers = rows.where(F.col("role") != SYSTEM).select(*key, F.col("role").alias("participant")).distinct()
    first = F.col("part") * part_turns
    old = F.coalesce(F.filter("told", lambda t: t["place"] < first), F.filter("turns", lambda t: F.lit(False)))
    parts = parts.join(told, key, "left").withColumn("old", old).withColumn("all", F.concat("old", "turns")).drop("told")
    carried = F.aggregate("old", F.lit(0).cast("bigint"), lambda acc, t: acc + F.char_length(_head(t["role"], F.col("participant"))) + F.char_length(t["text"]) + len(END))
    return _rendered(
        parts.join(speakers, key), "all", "conv_id", "participant", "part", F.ceil(F.col("n") / part_turns).cast("bigint").alias("n_parts"), first.alias("first_turn"), F.size("turns").cast("bigint").alias("n_turns"), carried.alias("carried")
    )


def _spans() -> Column:
    return F.array_join(F.transform("mask", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate(table(spark, sf_dir, "conversations")).withColumn("mask", _spans())


def query_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_whole(table(spark, sf_dir, "conversations")).withColumn("mask", _spans())


#: Turns of the table as they are written.
PLAIN = r"""
  SELECT conv_id, turn, regexp_replace(regexp_replace(coalesce(role, 'unknown'), '<(\\*)\|', '<\1\\|', 'g'), '[\r\n]', ' ', 'g') AS role,
         regexp_replace(coalesce(text, ''), '<(\\*)\|', '<\1\\|', 'g') AS text
  FROM conversations
"""

SQL = rf"""
WITH t AS ({PLAIN}),
speakers AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
views AS (
  SELECT t.conv_id, participant, turn, role, text, role = participant AS own,
         '<|start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM t JOIN speakers s ON t.conv_id IS NOT DISTINCT FROM s.conv_id
),
placed AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, participant ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) - length(text) - 8 AS lo
  FROM views
)
SELECT conv_id, participant, count(*) AS n_turns,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS text,
       coalesce(string_agg(CAST(lo AS BIGINT) || ':' || CAST(lo + length(text) AS BIGINT), ',' ORDER BY turn NULLS FIRST, role, text) FILTER (own), '') AS mask,
       CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, participant
"""

SQL_WHOLE = rf"""
WITH t AS (
  SELECT conv_id, role, text, row_number() OVER w - 1 AS place, count(*) OVER (PARTITION BY conv_id) AS n, (row_number() OVER w - 1) // 64 AS part
  FROM ({PLAIN})
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
),
speakers AS (SELECT DISTINCT conv_id, role AS participant FROM t WHERE role <> 'system'),
items AS (
  SELECT conv_id, part, n, place, role, text, false AS old FROM t
  UNION ALL
  SELECT t.conv_id, p.part, t.n, place, role, text, true FROM t JOIN (SELECT DISTINCT conv_id, part FROM t) p
    ON t.conv_id IS NOT DISTINCT FROM p.conv_id AND t.role = 'system' AND t.place < p.part * 64
),
views AS (
  SELECT i.conv_id, participant, part, n, place, role, text, old, role = participant AS own,
         '<|start|>' || CASE WHEN role = participant THEN 'assistant' WHEN role = 'system' THEN 'system' ELSE 'user name=' || role END || chr(10) AS head
  FROM items i JOIN speakers s ON i.conv_id IS NOT DISTINCT FROM s.conv_id
),
placed AS (
  SELECT *, sum(length(head) + length(text) + 8) OVER (PARTITION BY conv_id, participant, part ORDER BY place) - length(text) - 8 AS lo
  FROM views
)
SELECT conv_id, participant, part, (max(n) + 63) // 64 AS n_parts, part * 64 AS first_turn, count(*) FILTER (NOT old) AS n_turns,
       CAST(coalesce(sum(length(head) + length(text) + 8) FILTER (old), 0) AS BIGINT) AS carried,
       string_agg(head || text || '<|end|>' || chr(10), '' ORDER BY place) AS text,
       coalesce(string_agg(CAST(lo AS BIGINT) || ':' || CAST(lo + length(text) AS BIGINT), ',' ORDER BY place) FILTER (own), '') AS mask,
       CAST(coalesce(sum(length(text)) FILTER (own), 0) AS BIGINT) AS n_masked
FROM placed GROUP BY conv_id, participant, part
"""
