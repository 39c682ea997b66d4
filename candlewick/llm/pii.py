"""Personal data by candidate gradient boosting, from DataFrame functions and Spark's own boosted trees.

High-recall generators propose spans that may overlap each other and the base spans: the base patterns, and tighter or
looser forms of the same kinds (a card beside other digits that the base match runs over, a number without a country code,
an address written with words). Each candidate gets format features (digits, check sum, issuer, address parts, groups) and
context features (the characters and words beside it, whether a base span covers it). Gradient-boosted trees score them; a
logistic fit on held-out templates calibrates the scores, and for each kind the least threshold with enough precision on
these selects redactions. Valid base spans always stay; selected candidates are added unless they are base spans
themselves, lie inside one, or overlap a better candidate of their kind.

The trees learn from ``EXAMPLES`` sentences that SQL makes from a counter: true values of all issuers, lengths and formats,
and look-alikes (versions, order numbers, dates, measurements, hexadecimal tokens, digits that fail the check sum), among
``FOR``, ``AGAINST`` and ``NEUTRAL`` contexts. A third of the contexts is held out whole, for the calibration and the
thresholds. They see none of the documents, so the model is the same at every size. What it finds in text that was written
by hand is measured in the tests.

Null and empty texts have no spans; texts are scanned whole, in
time linear in their length; repeated rows get equal
results; ties between candidates go to the earlier and longer; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import field, saved, table
from .spans import around, chunks, empty_spans, find_spans, joined, let, number_of

# The base kinds. Possessive forms and look-behinds bound the work and change no match.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ["email", "ip", "card", "phone"]
CARD_DIGITS, PHONE_DIGITS = (14, 19), (10, 15)

#: kind, what a text must match at all, pattern of further candidates.
GENERATORS = [
    ("card", "[0-9]{13}", r"(?<![0-9])[0-9]{13,19}(?![0-9])"),
    ("card", "[0-9]{4}[ -][0-9]{4}", r"(?<![0-9])[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?(?![0-9])"),
    ("card", "[0-9]{4}[ -][0-9]{6}", r"(?<![0-9])[0-9]{4}([ -])[0-9]{6}\1[0-9]{4,5}(?![0-9])"),
    ("phone", r"\+[0-9]", r"\+[0-9]{1,3}[ .-]?\(?[0-9]{2,4}\)?[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"[0-9]{3}\)?[ .-][0-9]{3}", r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|[.-][0-9])"),
    ("phone", r"0[0-9]{1,4}[ /-][0-9]", r"(?<![0-9+.,/-])\(?0[0-9]{1,4}\)?[ /-][0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}(?![0-9]|[.,/-][0-9])"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9])"),
    ("email", r"[\[( ](?i:at)[\]) ]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} ?[\[(](?i:at)[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[(](?i:dot)[\])]|\.) ?[A-Za-z0-9-]{2,63})+"),
    ("email", r" (?i:at) ", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{2,64} (?i:at) [A-Za-z0-9-]{1,63}(?: (?i:dot) [A-Za-z0-9-]{2,63})+(?![A-Za-z0-9])"),
]
WORDS_FOR = "call|phone|tel|telephone|mobile|cell|fax|ring|card|visa|mastercard|amex|credit|paid|pay|charged|mail|email|e-mail|contact|write|reach|host|server|address|login|from|client|whatsapp|sms|dial|text"
WORDS_AGAINST = "version|build|release|order|isbn|issn|ean|id|ref|hash|commit|serial|invoice|section|chapter|token|sha|part|model|batch|lot|tracking|parcel|ticket|case|figure|table|page|article|firmware|driver|schema"
#: Characters of context, and of a stretch of text in which spans that overlap meet.
CONTEXT, STRETCH = 40, 64
EXAMPLES = 16_000
TREES, DEPTH = 30, 5
PRECISION = 0.97
# Prefixes and lengths of card issuers, and how their numbers begin.
CARDS = [("4", 16), ("4", 13), ("4", 19), ("51", 16), ("55", 16), ("2221", 16), ("2720", 16), ("34", 15), ("37", 15), ("6011", 16), ("65", 16), ("3528", 16), ("36", 14), ("300", 14), ("62", 17), ("62", 19), ("50", 18)]
ISSUER = "^(?:4|5[0-8]|2[2-7]|3[04-8]|6)"
#: Contexts of the examples, before and after the value.
FOR = [("call me on ", " tonight"), ("Tel: ", ""), ("phone ", ", ask for Ann"), ("you can reach her at ", "."), ("paid with card ", " on Monday"), ("Visa ", " exp 09/27"), ("contact ", " for details"), ("e-mail to ", "."), ("host ", " is down"), ("login from ", " failed"), ("mobile=", ";"), ("write to (", ")"), ("my number is ", "!"), ("server ", ":8080"), ("fax ", "\n"), ("credit card no. ", "")]
NEUTRAL = [("", ""), ("we saw ", " there"), ("then ", " and "), ("(", ")"), ("\"", "\""), ("it was ", "."), ("| ", " |"), ("bitte ", " notieren"), ("merci, ", " et"), ("luego ", " y"), ("- ", "\n- next"), ("see ", ";"), ("yesterday ", ","), ("[", "]"), ("so ", " 12 times"), ("on 3 May ", " came")]
AGAINST = [("version ", " is out"), ("order ", " shipped"), ("isbn ", "."), ("ref: ", ""), ("sha ", "c0"), ("commit 5b", "e1"), ("serial no ", ","), ("invoice #", " of May"), ("section ", ".2 says"), ("part #", "/2"), ("token = \"a9f", "e07\""), ("tracking ", " left"), ("model ", "-B"), ("batch ", " passed"), ("build ", "-rc1"), ("chapter ", " ends")]
FEATURES = ["is_email", "is_ip", "is_card", "is_phone", "n_digits", "n_chars", "check_sum", "issuer", "parts_fit", "digits_fit", "groups", "plus", "brackets", "separators", "left_word", "right_word", "left_dot", "right_dot", "left_digit", "right_digit", "hex_beside", "in_base", "for", "against"]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn_sum(digits: Column, doubled: int) -> Column:
    """The check sum's total from the last digit on; ``doubled`` is 1 if the last digit counts once, 0 if double."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == doubled, c.cast("int") * 2 - F.when(c > "4", 9).otherwise(0)).otherwise(c.cast("int")))
    return F.aggregate(each, F.lit(0), lambda acc, x: acc + x)


def luhn(value: Column) -> Column:
    """Whether the digits, if there are 1 to 19, pass the check sum."""
    digits = _digits(value)
    return F.when(F.char_length(digits).between(1, CARD_DIGITS[1]), luhn_sum(digits, 1) % 10 == 0).otherwise(False)


def parts_fit(value: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
    return F.rlike(value, F.lit(rf"^{part}(?:\.{part}){{3}}$"))


def _valid(s: Column) -> Column:
    n = F.char_length(_digits(s["value"]))
    return (
        F.when(s["kind"] == "email", F.lit(True))
        .when(s["kind"] == "ip", parts_fit(s["value"]))
        .when(s["kind"] == "card", F.when(n.between(*CARD_DIGITS), luhn(s["value"])).otherwise(False))
        .otherwise(n.between(*PHONE_DIGITS))
    )


def _if(text: Column, mark: str, spans: Column) -> Column:
    return F.when(F.rlike(text, F.lit(mark)), spans).otherwise(empty_spans())


def base_spans(text: Column) -> Column:
    found = F.concat(
        F.when(F.contains(text, F.lit("@")), find_spans(text, EMAIL, "email")).otherwise(empty_spans()),
        _if(text, r"[0-9]\.[0-9]", find_spans(text, IP, "ip")),
        _if(text, r"[0-9][\x20-]?[0-9]", F.filter(find_spans(text, CARD, "card"), lambda s: F.char_length(s["value"]) >= CARD_DIGITS[0])),
        _if(text, r"\+[0-9]", find_spans(text, PHONE, "phone")),
    )
    return F.filter(found, _valid)


def candidate_spans(text: Column) -> Column:
    return F.concat(*[_if(text, mark, find_spans(text, pattern, kind)) for kind, mark, pattern in GENERATORS])


def with_context(text: Column, spans: Column) -> Column:
    """Spans with the characters on both sides."""

    def one(s: Column, pieces: Column) -> Column:
        left, right = around(pieces, s["start"], s["end"], CONTEXT)
        return F.struct(*[s[c].alias(c) for c in ("start", "end", "kind", "value")], left.alias("left"), right.alias("right"))

    # Texts without a span aren't cut up.
    return let(F.when(F.size(spans) > 0, chunks(text)).otherwise(F.array().cast("array<string>")), lambda pieces: F.transform(spans, lambda s: one(s, pieces)))


def candidates(found: DataFrame) -> DataFrame:
    """row, span (with context and in_base), inside: each candidate of ``found`` (row, base, other) once.

    ``in_base`` is whether a base span of its kind overlaps it, ``inside`` whether one holds it whole. Base spans of a kind
    are apart from each other, so the last that begins no later and the first that begins later tell.
    """
    own = ["start", "end", "kind", "value"]
    ahead = F.transform("base", lambda s: F.struct(*[s[c].alias(c) for c in own], F.lit("").alias("left"), F.lit("").alias("right"), F.lit(True).alias("is_base")))
    new = F.transform("other", lambda s: F.struct(*[s[c].alias(c) for c in (*own, "left", "right")], F.lit(False).alias("is_base")))
    each = found.where(F.size("other") > 0).select("row", F.explode(F.concat(ahead, new)).alias("s")).select("row", "s.*")
    by, run = Window.partitionBy("row", "kind"), (Window.unboundedPreceding, Window.currentRow)
    begun = by.orderBy("start", F.desc("is_base"), "end").rowsBetween(*run)
    later = by.orderBy(F.desc("start"), "is_base", "end").rowsBetween(*run)
    each = each.withColumn("to", F.last(F.when(F.col("is_base"), F.col("end")), ignorenulls=True).over(begun))
    each = each.withColumn("next", F.last(F.when(F.col("is_base"), F.col("start")), ignorenulls=True).over(later))
    each = each.where(~F.col("is_base")).dropDuplicates(["row", "kind", "start", "end"])
    in_base = F.coalesce(F.col("to") > F.col("start"), F.lit(False)) | F.coalesce(F.col("next") < F.col("end"), F.lit(False))
    return each.select("row", F.struct(*own, "left", "right", in_base.alias("in_base")).alias("span"), F.coalesce(F.col("to") >= F.col("end"), F.lit(False)).alias("inside"))


def best(good: DataFrame) -> DataFrame:
    """row, added: the spans of ``good`` (row, span, chance) that no better one of their kind overlaps.

    Spans that overlap share a stretch of STRETCH characters, in which there are few: those of one pattern are apart.
    """
    span = F.struct(F.round(-F.col("chance"), 9).alias("rank"), F.col("span.start").alias("start"), (-F.col("span.end")).alias("last"), F.col("span.end").alias("end"), F.col("span.value").alias("value"))
    stretch = F.explode(F.sequence(F.floor(F.col("span.start") / STRETCH), F.floor((F.col("span.end") - 1) / STRETCH)))
    met = good.select("row", F.col("span.kind").alias("kind"), span.alias("s"), stretch.alias("stretch")).groupBy("row", "kind", "stretch").agg(F.collect_list("s").alias("near"))
    beats = lambda b, a: (a["start"] < b["end"]) & (b["start"] < a["end"]) & (F.struct(b["rank"], b["start"], b["last"]) < F.struct(a["rank"], a["start"], a["last"]))
    told = met.select("row", "kind", F.explode(F.transform("near", lambda a: F.struct(a["start"].alias("start"), a["end"].alias("end"), a["value"].alias("value"), F.exists("near", lambda b: beats(b, a)).alias("beaten")))).alias("s"))
    kept = told.groupBy("row", "kind", "s.start", "s.end").agg(F.max("s.beaten").alias("beaten"), F.first("s.value").alias("value")).where(~F.col("beaten"))
    return kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "end", "kind", "value"))).alias("added"))


def features(spans: DataFrame) -> DataFrame:
    """``spans`` (span: a span with context) with the columns FEATURES."""
    s, value = F.col("span"), F.col("span.value")
    left, right, n = F.lower(s["left"]), s["right"], F.char_length(_digits(value))
    columns = {f"is_{k}": s["kind"] == k for k in KINDS} | {
        "n_digits": n,
        "n_chars": F.char_length(value),
        "check_sum": luhn(value),
        "issuer": F.rlike(_digits(value), F.lit(ISSUER)),
        "parts_fit": parts_fit(value),
        "digits_fit": F.when(s["kind"] == "card", n.between(*CARD_DIGITS)).otherwise(n.between(*PHONE_DIGITS)),
        "groups": F.size(F.split(value, "[^0-9]+")),
        "plus": F.startswith(value, F.lit("+")),
        "brackets": F.rlike(value, F.lit(r"[(\[]")),
        "separators": F.size(F.array_distinct(F.split(F.regexp_replace(value, r"[^ ./-]", ""), ""))),
        "left_word": F.rlike(left, F.lit(r"[\p{L}0-9_]$")),
        "right_word": F.rlike(right, F.lit(r"^[\p{L}0-9_]")),
        "left_dot": F.rlike(left, F.lit(r"[0-9][.:/-]$|[#=/\"'-]$")),
        "right_dot": F.rlike(right, F.lit(r"^[.:/-][0-9]|^[\"'/=-]")),
        "left_digit": F.rlike(left, F.lit(r"[0-9][ ,-]?$")),
        "right_digit": F.rlike(right, F.lit(r"^[ ,-]?[0-9]")),
        "in_base": s["in_base"],
        "hex_beside": F.rlike(left, F.lit(r"[a-f][0-9a-f]*$")) | F.rlike(right, F.lit(r"^[0-9a-f]*[a-f]")),
        "for": F.rlike(left, F.lit(rf"\b(?:{WORDS_FOR})\b")),
        "against": F.rlike(left, F.lit(rf"\b(?:{WORDS_AGAINST})\b")),
    }
    return spans.select("*", *[columns[f].cast("double").alias(f) for f in FEATURES])


def examples(spark: SparkSession, n: int = EXAMPLES) -> DataFrame:
    """id, held (whether its context is held out), text, kind, value, label: sentences made from a counter, and what stands in them."""
    i = F.col("id")
    draw = lambda k, m: F.pmod(F.xxhash64(i, F.lit(k)), F.lit(m)).cast("int")
    pad = lambda x, w: F.lpad(x.cast("string"), w, "0")
    pick = lambda xs, k: F.element_at(F.array(*[x if isinstance(x, Column) else F.lit(x) for x in xs]), (k if isinstance(k, Column) else draw(k, len(xs))).cast("int") + 1)
    cat, few = F.concat, lambda k, w: pad(draw(k, 10**w), w)
    # Cards: an issuer's prefix and length, a check digit, a grouping.
    which = draw(1, len(CARDS))
    stem = F.rpad(cat(pick([c[0] for c in CARDS], which), few(2, 6), few(3, 6), few(4, 6)), 30, "7").substr(F.lit(1), pick([c[1] for c in CARDS], which) - 1)
    digit = F.pmod(F.lit(10) - luhn_sum(stem, 0) % 10, F.lit(10))
    card, bad = cat(stem, digit.cast("string")), cat(stem, F.pmod(digit + 1 + draw(5, 9), F.lit(10)).cast("string"))
    bad = F.when(bad == card, cat(stem, F.pmod(digit + 1, F.lit(10)).cast("string"))).otherwise(bad)
    grouped = lambda x: F.when(F.char_length(x) == 15, F.regexp_replace(x, "^(.{4})(.{6})", cat(F.lit("$1"), pick(" -", 6), F.lit("$2"), pick(" -", 6)))).otherwise(F.regexp_replace(x, "(.{4})(?=.)", cat(F.lit("$1"), pick(" -", 6))))
    # Phones: with a country code, without one, and with a leading zero.
    sep = pick([" ", "-", ".", ""], 7)
    some = pick([" ", "-", "."], 7)
    world = cat(F.lit("+"), (draw(8, 98) + 1).cast("string"), pick([" ", "-", " (0) "], 9), (draw(10, 890) + 100).cast("string"), sep, few(11, 3), sep, few(12, 4))
    local = F.when(draw(13, 2) == 0, cat(F.lit("("), few(14, 3), F.lit(") "), few(15, 3), F.lit("-"), few(16, 4))).otherwise(cat(few(14, 3), some, few(15, 3), some, few(16, 4)))
    zero = cat(F.lit("0"), (draw(17, 890) + 10).cast("string"), pick([" ", "/", "-"], 18), few(19, 3), pick([" ", "-"], 20), few(21, 4))
    ip = F.concat_ws(".", *[draw(k, 256).cast("string") for k in (22, 23, 24, 25)])
    name, site = pick(["ann", "j.smith", "info", "sales2", "m_lopez", "k-tan"], 26), pick(["mail", "example", "post7", "uni-x"], 27)
    at, dot = pick([" [at] ", "[at]", " (at) ", "(AT)", " at "], 28), pick([" [dot] ", "[dot]", ".", " (dot) ", " dot "], 29)
    email = cat(name, at, site, F.when(at == " at ", F.lit(" dot ")).otherwise(dot), pick(["org", "com", "de", "co"], 30))
    beside = pick([cat(F.lit(" "), pick(["4111111111111111", "5555555555554444", "378282246310005"], 51)), cat(F.lit(" "), few(31, 3)), cat(F.lit(" "), ip), cat(F.lit(" "), few(32, 8)), F.lit("")], 33)
    spaced = lambda x: cat(F.lit(" "), x, F.lit(" "))
    date, small = cat((draw(34, 80) + 1950).cast("string"), F.lit("-"), few(35, 2), F.lit("-"), few(36, 2), F.lit(" "), few(37, 4)), F.concat_ws(".", *[draw(k, 12).cast("string") for k in (38, 39, 40, 41)])
    # kind, value, what stands right beside it, label by the kind of context: for, neutral, against.
    none = F.lit("")
    cases = [
        ("card", card, beside, 1, 1, 0), ("card", grouped(card), beside, 1, 1, 1), ("card", bad, none, 0, 0, 0), ("card", grouped(bad), none, 0, 0, 0), ("card", cat(F.lit("0"), few(42, 9), few(43, 6)), none, 0, 0, 0),
        ("phone", world, beside, 1, 1, 1), ("phone", local, none, 1, 1, 0), ("phone", zero, none, 1, 1, 0), ("phone", local, spaced(few(44, 4)), 1, 1, 0), ("phone", cat(few(14, 3), F.lit(" "), few(15, 3), F.lit(" "), few(16, 4), F.lit(" "), few(45, 3)), none, 0, 0, 0), ("phone", cat(F.lit("0"), date), none, 0, 0, 0),
        ("ip", ip, none, 1, 1, 1), ("ip", ip, F.lit(".7"), 0, 0, 0), ("ip", small, none, 1, 1, 0), ("ip", F.concat_ws(".", (draw(46, 500) + 256).cast("string"), few(47, 3), F.lit("1"), F.lit("2")), none, 0, 0, 0),
        ("email", email, none, 1, 1, 1), ("email", cat(name, F.lit(" at "), site, F.lit(" and more")), none, 0, 0, 0),
    ]
    case, sort = F.pmod(i, F.lit(len(cases))), draw(48, 3)
    contexts = [FOR, NEUTRAL, AGAINST]
    context = draw(49, 16)
    of = lambda k: pick([pick([c[k] for c in xs], context) for xs in contexts], sort)
    rows = spark.range(0, n, 1, 2).select(
        "id", ((context + sort) % 3 == 0).alias("held"), pick([c[0] for c in cases], case).alias("kind"), pick([c[1] for c in cases], case).alias("value"), pick([c[2] for c in cases], case).alias("beside"),
        of(0).alias("before"), of(1).alias("after"), pick([pick(list(c[3:]), sort) for c in cases], case).alias("label"),
    )
    ahead = pick(["", "Well, ", "On the way home ", "Hallo, ", "Oui: ", "{", "2. "], 50)
    # What is beside a number stands before it as often as behind it.
    turned = F.startswith(F.col("beside"), F.lit(" ")) & (draw(52, 2) == 0)
    both = F.when(turned, cat(F.ltrim("beside"), F.lit(" "), "value")).otherwise(cat("value", "beside"))
    return rows.select("id", "held", cat(ahead, "before", both, "after", F.lit(" .")).alias("text"), "kind", "value", "label")


class Model:
    """Boosted trees, their calibration, and a threshold for each kind."""

    def __init__(self, spark: SparkSession, n: int = EXAMPLES, trees: int = TREES, precision: float = PRECISION):
        rows = saved(examples(spark, n), "pii-sentences").withColumn("base", base_spans(F.col("text")))
        every = with_context(F.col("text"), F.concat(candidate_spans(F.col("text")), "base"))
        spans = candidates(rows.select(F.col("id").alias("row"), "base", every.alias("other"))).join(rows, F.col("row") == F.col("id"))
        right = (F.col("span.value") == F.col("value")) & (F.col("span.kind") == F.col("kind"))
        about = F.contains(F.col("value"), F.col("span.value")) | F.contains(F.col("span.value"), F.col("value"))
        # A word that runs on into the context makes another address, of which nothing is known.
        known = right | (F.col("span.kind") != "email") | ~F.contains(F.col("span.value"), F.col("value"))
        data = features(spans.where(about & known)).withColumn("y", F.when(right, F.col("label")).otherwise(0).cast("double"))
        data = saved(data.select("id", "held", "span", "y", *FEATURES).repartition(2, "id").sortWithinPartitions("id", "span"), "pii-examples")
        fit, hold = data.where("not held").coalesce(2), data.where("held").coalesce(2)
        assemble = VectorAssembler(inputCols=FEATURES, outputCol="x")
        trees_model = GBTClassifier(featuresCol="x", labelCol="y", maxIter=trees, maxDepth=DEPTH, seed=7).fit(assemble.transform(fit))
        scored = trees_model.transform(assemble.transform(hold))
        platt = LogisticRegression(featuresCol="rawPrediction", labelCol="y", predictionCol="is_pii", probabilityCol="calibrated", rawPredictionCol="margin", regParam=1e-4).fit(scored)
        self.stages = PipelineModel([assemble, trees_model, platt])
        # A table of 50 rows for each kind.
        held = self.score(hold).select(F.col("span.kind").alias("kind"), F.floor(F.col("chance") * 50).alias("bin"), "y").groupBy("kind", "bin").agg(F.sum("y").alias("hits"), F.count(F.lit(1)).alias("n")).collect()
        self.thresholds, self.held_out = {}, {}
        for kind in KINDS:
            bins = sorted(((r["bin"], r["hits"], r["n"]) for r in held if r["kind"] == kind), reverse=True)
            true, hits, n_all = sum(b[1] for b in bins), 0.0, 0.0
            self.thresholds[kind] = 1.01
            for at, (b, h, m) in enumerate(bins):
                hits, n_all = hits + h, n_all + m
                if hits >= precision * n_all:
                    # Half way down to the next scores that were seen.
                    below = bins[at + 1][0] + 1 if at + 1 < len(bins) else 0
                    self.thresholds[kind] = max(0.5, (b + below) / 100)
                    #: Precision and recall on the held-out contexts.
                    self.held_out[kind] = (hits / n_all, hits / max(true, 1.0))

    def score(self, spans: DataFrame) -> DataFrame:
        """``spans`` with the column chance, the calibrated probability."""
        return self.stages.transform(spans).withColumn("chance", vector_to_array("calibrated")[1])


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Model | None = None) -> DataFrame:
    """doc_id, base and added (arrays of spans) for each row."""
    text = F.coalesce(field(docs, text_col).cast("string"), F.lit(""))
    rows = docs.select(field(docs, id_col).alias("doc_id"), text.alias("text"))
    found = rows.select("doc_id", base_spans(F.col("text")).alias("base"), with_context(F.col("text"), candidate_spans(F.col("text"))).alias("other"))
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "pii-found")
    model = model or Model(docs.sparkSession)
    least = F.create_map(*[x for k, t in model.thresholds.items() for x in (F.lit(k), F.lit(t))])
    # What lies inside a base span of its kind is redacted with it.
    scored = model.score(features(candidates(found).where(~F.col("inside"))))
    good = best(scored.where(F.col("chance") >= F.element_at(least, F.col("span.kind"))))
    return found.join(good, "row", "left").select("doc_id", "base", F.coalesce("added", empty_spans()).alias("added"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = detect(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        *[number_of(F.col("base"), k).alias(f"n_{k}") for k in KINDS],
        F.sha2(joined(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), KINDS).alias("spans"),
        F.size("added").cast("bigint").alias("n_added"),
        (F.size("base") + F.size("added")).cast("bigint").alias("n_spans"),
    )
