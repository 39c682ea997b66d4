"""Secret scan with corpus-wide ownership frequency, from built-in functions alone.

Candidates are assignments to secret-like names, access key ids, long hexadecimal runs and tokens of known formats.
Each candidate's value is hashed, and the hashes are counted over the whole corpus by distinct owners and by distinct
repositories, each in two steps that both have a map-side part. A value that stands with more than ``max_owners`` owners,
or in more than ``max_repositories`` repositories, be they of one owner, is an example that was copied about; any other
one is owner-specific and looks live. The base kinds always stay as spans; candidates of the other formats become spans
where their value looks live. The counts come with each row, so that another rule can be laid over them.

The hash of a widely copied value may stand in a third of all rows; its rows carry no text, and the join with the counts
(one row for each hash, written out first) is one that adaptive execution splits.

Null text counts as empty and a null owner or repository as one of its own. Repeated rows of a repository count once
for frequency and each get their own result. Ties in the order of spans go by kind, then end. Texts are scanned whole,
in time linear in their length; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import field, saved, table
from .spans import empty_spans, find_spans, joined, number_of

# The base kinds.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BASE = ["assign", "access", "hex"]
ASSIGN_VALUE = 12

#: Further formats: kind, what a text must contain to have it, pattern, group of the value.
FORMATS = [
    ("forge_token", "gh", r"\bgh[pousr]_[A-Za-z0-9]{36,}", 0),
    ("payment_key", "_live_", r"\b[sr]k_live_[A-Za-z0-9]{16,}", 0),
    ("chat_token", "xox", r"\bxox[abeprs]-[A-Za-z0-9-]{10,}", 0),
    ("map_key", "AIza", r"\bAIza[A-Za-z0-9_-]{35}", 0),
    ("web_token", "eyJ", r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0),
    ("private_key", "PRIVATE KEY-----", r"-----BEGIN (?:[A-Z0-9]++ )*?PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,}+)", 1),
    ("bearer", "earer ", r"\b[Bb]earer ([A-Za-z0-9._~+/-]{20,}=*)", 1),
    ("url_login", "://", r"(?<![A-Za-z0-9+.-])[a-z0-9+.-]++://[^\s:/@]++:([^\s:/@]{8,}+)@", 1),
]
#: More owners or repositories than these make a value a copied example.
MAX_OWNERS, MAX_REPOSITORIES = 2, 10


def _base(text: Column) -> Column:
    lower = F.lower(text)
    named = F.lit(False)
    for word in ("password", "passwd", "secret", "token", "apikey", "api_key"):
        named = named | F.contains(lower, F.lit(word))
    assign = F.when(named, F.filter(find_spans(text, ASSIGN, "assign", 2), lambda s: F.char_length(s["value"]) >= ASSIGN_VALUE)).otherwise(empty_spans())
    access = F.when(F.contains(text, F.lit("AKIA")), find_spans(text, ACCESS, "access")).otherwise(empty_spans())
    return F.concat(assign, access, find_spans(text, HEX, "hex"))


def _other(text: Column) -> Column:
    return F.concat(*[F.when(F.contains(text, F.lit(mark)), find_spans(text, pattern, kind, group)).otherwise(empty_spans()) for kind, mark, pattern, group in FORMATS])


def ownership(candidates: DataFrame) -> DataFrame:
    """hash, owners, repositories for candidates (hash, owner, repository): distinct ones over the whole corpus."""
    of = F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("name")) for c in ("owner", "repository")])
    each = candidates.select("hash", F.explode(of).alias("of")).select("hash", "of.*").distinct()
    return each.groupBy("hash").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(n) for k, n in (("owner", "owners"), ("repository", "repositories"))])


def scan(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    owner_col: str = "source",
    repository_col: str = "doc_id",
    max_owners: int = MAX_OWNERS,
    max_repositories: int = MAX_REPOSITORIES,
) -> DataFrame:
    """doc_id, base and added (arrays of spans), n_live and n_copied (base spans by ownership), most_owners and most_repositories (of one value of the row) for each row."""
    rows = docs.select(
        field(docs, id_col).alias("doc_id"),
        F.coalesce(field(docs, text_col).cast("string"), F.lit("")).alias("text"),
        field(docs, owner_col).cast("string").alias("owner"),
        field(docs, repository_col).cast("string").alias("repository"),
    )
    found = rows.select("doc_id", "owner", "repository", _base(F.col("text")).alias("base"), _other(F.col("text")).alias("other"))
    found = saved(found.withColumn("row", F.monotonically_increasing_id()), "secrets-found")
    each = found.where((F.size("base") > 0) | (F.size("other") > 0)).select("row", "owner", "repository", F.size("base").alias("n_base"), F.posexplode(F.concat("base", "other")).alias("at", "span"))
    each = each.withColumn("hash", F.unhex(F.sha2(F.col("span.value").cast("binary"), 256)))
    owned = saved(ownership(each.select("hash", "owner", "repository")), "secrets-owned")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    is_base = F.col("at") < F.col("n_base")
    judged = each.join(owned, "hash").groupBy("row").agg(
        F.collect_list(F.when(live & ~is_base, F.col("span"))).alias("added"),
        F.count(F.when(live & is_base, 1)).alias("n_live"),
        F.count(F.when(~live & is_base, 1)).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repositories").alias("most_repositories"),
    )
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_live", "n_copied", "most_owners", "most_repositories")]
    return found.join(judged, "row", "left").select("doc_id", "base", F.coalesce("added", empty_spans()).alias("added"), *counts)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(table(spark, sf_dir, "documents"))
    kinds = [*BASE, *(f[0] for f in FORMATS)]
    return out.select(
        "doc_id",
        *[number_of(F.col("base"), k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(F.col("base"), kinds).cast("binary"), 256).alias("base_sha256"),
        joined(F.concat("base", "added"), kinds).alias("spans"),
        *["n_live", "n_copied", "most_owners", "most_repositories"],
    )
