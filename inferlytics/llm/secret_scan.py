"""Secrets by corpus-wide ownership: who else has the same value?

Candidates are assignments, access keys and long hexadecimal runs (base), and forms that only the ownership test makes
worth reporting (service tokens, web tokens, key headers). Each candidate's value is hashed; the hashes are counted by
distinct repository and owner over the whole corpus, first combined per (hash, repository, owner) so that a value copied
everywhere is a few rows. A value with ``OWNERS`` or more owners is a widely copied example, and so is one that spreads over
``REPOSITORIES`` or more repositories of at least two owners; an owner's own value in many of the owner's repositories is
not. One that is no example and looks random is reported as live. Both counts are returned with each span. Base spans stay whatever the verdict; other forms are added only when live.

Here an owner is a document's source and a repository is a source and language. Nulls: a null text has no candidates, a
null owner is the owner ''. Repeated rows are returned as often as they occur. An empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferlytics.llm.common import find_spans, settle, span_text, table

OWNERS = 3
REPOSITORIES = 4
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {  # kind: (pattern, gate, base), in the order of ranks
    "assign": (ASSIGN, r"(?i:passw|secret|token|api_?key)", True),
    "access": (r"AKIA[A-Z0-9]+", "AKIA", True),
    "hex": (r"(?<![0-9a-f])[0-9a-f]{16,}+", r"[0-9a-f]{16}", True),
    "service": (r"(?<![A-Za-z0-9_])(?:gh[pousr]_[A-Za-z0-9]{30,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk_live_[A-Za-z0-9]{16,}+)", r"gh[pousr]_|xox[abprs]-|sk_live_", False),
    "web": (r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]++", "eyJ", False),
    "key": (r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----\s*[A-Za-z0-9+/=\s]{40,}+", "PRIVATE KEY-----", False),
}
LEAST = {"assign": 12, "access": 18}


def secret(kind: str, value: Column) -> Column:
    """The part of a match that is the secret itself."""
    return F.regexp_extract(value, ASSIGN, 2) if kind == "assign" else value


def looks_live(value: Column) -> Column:
    """Many different characters, digits and letters, and no placeholder word."""
    kinds = F.size(F.array_distinct(F.split(value, "")))
    return (kinds >= 8) & value.rlike("[0-9]") & value.rlike("[A-Za-z]") & ~value.rlike(r"(?i)example|sample|changeme|dummy|your|xxxx|1234567|abcdef")


def _spans(text: Column, kind: str) -> Column:
    pattern, gate, base = PATTERNS[kind]
    spans = find_spans(text, pattern, text.rlike(gate))
    if kind in LEAST:
        spans = F.filter(spans, lambda s: F.length(secret(kind, s["value"])) >= LEAST[kind])

    def one(s: Column) -> Column:
        value = secret(kind, s["value"])
        return F.struct(
            s["start"].alias("start"),
            F.lit(list(PATTERNS).index(kind)).alias("rank"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            looks_live(value).alias("random"),
            F.sha2(value, 256).alias("hash"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame, owner: Column, repository: Column) -> DataFrame:
    """(row, doc_id, owner, repository, found): every row with its candidate spans; values are kept as hashes only."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(owner, F.lit("")).alias("owner"),
        F.coalesce(repository, F.lit("")).alias("repository"),
        F.concat(*[_spans(text, kind) for kind in PATTERNS]).alias("found"),
    )
    return settle(rows, "secrets")


def ownership(spans: DataFrame) -> DataFrame:
    """(hash, owners, repositories) over all candidates."""
    places = spans.select("s.hash", "owner", "repository").distinct()
    by_owner = places.groupBy("hash", "owner").agg(F.count("*").alias("n"))
    return by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"))


def scan(docs: DataFrame, owner: Column, repository: Column, owners: int = OWNERS, repositories: int = REPOSITORIES) -> DataFrame:
    """Per row: counts and digest of the base spans, all spans, how many are live, examples or neither, the live ones, and
    ``ownership``: start:owners:repositories of every span."""
    rows = candidates(docs, owner, repository)
    spans = rows.select("row", "owner", "repository", F.explode("found").alias("s")).withColumn("hash", F.col("s.hash"))
    judged = spans.join(ownership(spans), "hash").select(
        "row",
        "s",
        "owners",
        "repositories",
        F.when((F.col("owners") >= owners) | ((F.col("owners") >= 2) & (F.col("repositories") >= repositories)), "example")
        .when(F.col("s.random"), "live")
        .otherwise("unclear")
        .alias("verdict"),
    )
    kept = judged.where(F.col("s.base") | (F.col("verdict") == "live"))
    fields = [F.col(f"s.{f}").alias(f) for f in ("start", "rank", "end", "kind", "base")]
    per_row = kept.groupBy("row").agg(F.array_sort(F.collect_list(F.struct(*fields, "verdict", "owners", "repositories"))).alias("spans"))
    out = rows.select("row", "doc_id").join(per_row, "row", "left").withColumn("spans", F.coalesce("spans", F.array()))
    base = F.filter("spans", lambda s: s["base"])
    out = out.withColumn("base", base)
    counts = [F.size(F.filter("base", _where("kind", k))).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    verdicts = [F.size(F.filter("spans", _where("verdict", v))).cast("long").alias(f"n_{v}") for v in ("live", "example", "unclear")]
    return out.select(
        "doc_id",
        *counts,
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"),
        span_text(F.col("spans")).alias("spans"),
        *verdicts,
        span_text(F.filter("spans", _where("verdict", "live"))).alias("live_spans"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws(":", *[s[f].cast("string") for f in ("start", "owners", "repositories")])), ",").alias("ownership"),
    )


def _where(field: str, value: str):
    return lambda s: s[field] == value


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
