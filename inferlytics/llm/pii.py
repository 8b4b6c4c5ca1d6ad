"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs the labelers and
its posteriors train the final span classifier.

Candidates of the kinds email, ip, card and phone are the strict matches (base) and wider forms (spelled-out addresses,
national numbers, longer address forms, dotted cards). Five labelers vote yes, no or nothing on each: the strict regex,
the value's form, a gazetteer (endings, issuers, country codes), the words before it, and its borders. The votes are
counted by pattern over all documents; on these counts (bounded by the number of patterns) a two-class model with one
vote distribution per labeler, class and kind is fitted by expectation-maximisation. A naive Bayes classifier on features
that no labeler uses alone is trained with the posteriors and decides on the wider candidates; base spans always stay.

Nulls and odd input: a null text counts as empty; documents without spans are returned with zero counts. Repeated rows
are returned as often as they occur. An empty table gives an empty result; extra columns are ignored. The patterns are
possessive, so they run in linear time on texts without spaces too. Only DataFrame functions touch rows.
"""

from __future__ import annotations

import math
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferlytics.llm.common import DOCUMENTS, find_spans, only, settle, span_text, table

KINDS = ("email", "ip", "card", "phone")
NEAR = 24  # characters before a span that the context labeler reads, back to the match before at most
ROUNDS = 60
MAIL = "[A-Za-z0-9._%+-]"
HOST = "[A-Za-z0-9-]"

BASE = {
    # the look-behind (or the end of the last match) is where a leftmost match of a run must begin
    "email": rf"(?:\G|(?<!{MAIL})){MAIL}++@{HOST}++(?:\.{HOST}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
GATE = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9](?:[\x20-]?[0-9]){12}", "phone": r"\+[0-9]"}
WIDE = {
    "email": rf"(?<!{MAIL}){MAIL}++\x20?[\[({{]at[\])}}]\x20?{HOST}++(?:\x20?(?:\.|[\[({{]dot[\])}}])\x20?{HOST}++)++",
    "ip": r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "card": r"(?<![0-9./])[0-9]{4}(?:[./_][0-9]{4}){3}(?![0-9./])",
    "phone": r"(?<![0-9+(])(?:00[1-9][0-9]{0,2}[\x20-])?\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
WIDE_GATE = {"email": r"[\[({]at[\])}]", "ip": r":[0-9A-Fa-f]{1,4}:", "card": r"[0-9]{4}[./_][0-9]{4}", "phone": r"[0-9]{3}[\x20.-][0-9]{4}"}
GAZETTEER = {
    "email": r"(?i)\.(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info)$",
    "ip": r"^(?:10|127|172|192|[1-9][0-9]?|1[0-9]{2}|2[0-2][0-9])\.",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6011|65)",
    "phone": r"^(?:\+|00)?(?:1|33|34|49|44|39)?[^0-9]*\(?[2-9]",
}
CUES = {
    "email": r"(?i)\b(?:e-?mail|mail|contact|write|correo|kontakt)\b",
    "ip": r"(?i)\b(?:ip|host|server|address|addr|login|from)\b",
    "card": r"(?i)\b(?:card|visa|credit|payment|karte|tarjeta|carte)\b",
    "phone": r"(?i)\b(?:tel|phone|call|fax|mobile|telefon|m[oó]vil)\b",
}
AGAINST = r"(?i)\b(?:version|isbn|issn|order|serial|section|chapter|figure|no)\b"
FEATURES = ("size", "before", "after", "digits")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.transform(
        F.split(F.reverse(digits), ""),
        lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)),
    )
    return F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(value, r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255)
        )
    n = F.length(_digits(value))
    if kind == "card":
        return n.between(13, 19) & luhn(_digits(value))
    if kind == "phone":
        return n.between(9, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    spans = find_spans(text, BASE[kind], text.rlike(GATE[kind]), NEAR)
    return F.filter(spans, lambda s: _valid(kind, s["value"])) if kind != "email" else spans


def _vote(yes: Column, no: Column) -> Column:
    return F.when(yes, "+").when(no, "-").otherwise("0")


def _form(kind: str, value: Column) -> Column:
    digits = _digits(value)
    if kind == "email":
        return _vote(value.rlike(r"[A-Za-z]{2,}$"), value.rlike(r"[.-]$|^[.-]"))
    if kind == "ip":
        return _vote(~value.rlike(r"(?:^|\.)0[0-9]|^0"), value.rlike(r"^0\."))
    if kind == "card":
        return _vote(luhn(digits) & F.length(digits).isin(13, 15, 16, 19), ~luhn(digits))
    return _vote(F.length(digits).between(10, 13), F.length(digits) > 15)


def _symbol(c: Column) -> Column:
    """Class of the character beside a span: space or none, letter, digit, other."""
    return F.when(c.rlike(r"^\s?$"), "s").when(c.rlike(r"^\p{L}$"), "a").when(c.rlike(r"^[0-9]$"), "9").otherwise("o")


def _described(kind: str, spans: Column, base: bool) -> Column:
    rank = KINDS.index(kind)

    def one(s: Column) -> Column:
        value, near, right = s["value"], s["left"], s["right"]
        left = F.right(near, F.lit(1))
        border = r"^[\p{L}0-9]$"
        share = F.length(_digits(value)) / F.length(value)
        votes = F.concat(
            F.lit("+" if base else "0"),
            _form(kind, value),
            _vote(value.rlike(GAZETTEER[kind]), F.lit(kind in ("card", "email"))),
            _vote(near.rlike(CUES[kind]), near.rlike(AGAINST)),
            _vote(~(left.rlike(border) | right.rlike(border)), left.rlike(border) & right.rlike(border)),
        )
        return F.struct(
            F.lit(rank).alias("rank"),
            s["start"].alias("start"),
            s["end"].alias("end"),
            F.lit(kind).alias("kind"),
            F.lit(base).alias("base"),
            votes.alias("votes"),
            F.least(F.floor(F.length(value) / 6), F.lit(5)).cast("string").alias("size"),
            _symbol(left).alias("before"),
            _symbol(right).alias("after"),
            F.floor(share * 4).cast("string").alias("digits"),
        )

    return F.transform(spans, one)


def candidates(docs: DataFrame) -> DataFrame:
    """The documents' columns and ``found``: array of all candidate spans with votes and features."""
    text = F.coalesce(F.col("text"), F.lit(""))
    spans = docs.withColumns(
        {f"_base_{k}": base_spans(text, k) for k in KINDS} | {f"_wide_{k}": find_spans(text, WIDE[k], text.rlike(WIDE_GATE[k]), NEAR) for k in KINDS}
    )
    parts = []
    for kind in KINDS:
        parts.append(_described(kind, F.col(f"_base_{kind}"), True))
        parts.append(_described(kind, _apart(F.col(f"_wide_{kind}"), F.col(f"_base_{kind}")), False))
    some = F.greatest(*[F.size(f"_{form}_{kind}") for form in ("base", "wide") for kind in KINDS]) > 0
    found = F.when(some, F.concat(*parts))
    return spans.withColumn("found", found).drop(*[f"_{form}_{k}" for form in ("base", "wide") for k in KINDS])


def _apart(wide: Column, base: Column) -> Column:
    """Wider spans that do not overlap a base span of their kind."""
    return F.filter(wide, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (w["start"] < b["end"])))


def fit_votes(rows: list[tuple[str, str, int]], rounds: int = ROUNDS) -> dict[tuple[str, str], float]:
    """Posterior of "personal data" per (kind, votes) by expectation-maximisation, from (kind, votes, n).

    It starts from the majority of the votes; each labeler has one smoothed vote distribution per kind and class.
    """
    out: dict[tuple[str, str], float] = {}
    for kind in KINDS:
        counts: dict[str, int] = defaultdict(int)
        for k, votes, n in rows:
            if k == kind:
                counts[votes] += n
        post = {v: (1 + v.count("+")) / (2 + v.count("+") + v.count("-")) for v in counts}
        for _ in range(rounds if counts else 0):
            mass = [sum(n * (post[v] if y else 1 - post[v]) for v, n in counts.items()) for y in (0, 1)]
            seen: dict[tuple[int, int, str], float] = defaultdict(float)
            for votes, n in counts.items():
                for j, vote in enumerate(votes):
                    seen[1, j, vote] += n * post[votes]
                    seen[0, j, vote] += n * (1 - post[votes])
            for votes in counts:
                odds = math.log((mass[1] + 1) / (mass[0] + 1))
                for j, vote in enumerate(votes):
                    # one smoothing count leans each labeler towards being right
                    lean = {"+": (1.5, 0.5), "-": (0.5, 1.5), "0": (1.0, 1.0)}[vote]
                    odds += math.log((seen[1, j, vote] + lean[0]) / (mass[1] + 3)) - math.log((seen[0, j, vote] + lean[1]) / (mass[0] + 3))
                post[votes] = 1 / (1 + math.exp(-max(-50.0, min(50.0, odds))))
        out |= {(kind, v): p for v, p in post.items()}
    return out


def train(found: DataFrame) -> dict[str, float]:
    """Log-odds weights ``kind|feature|value`` (and ``kind|prior|``) of the span classifier.

    What reaches the driver is one row for each pattern of votes and features, which the code bounds.
    """
    spans = found.select(F.explode("found").alias("s")).groupBy("s.kind", "s.votes", *[f"s.{f}" for f in FEATURES]).agg(F.count("*").alias("n"))
    rows = spans.collect()
    post = fit_votes([(r["kind"], r["votes"], r["n"]) for r in rows])
    mass: dict[tuple[str, int], float] = defaultdict(float)
    seen: dict[tuple[str, int], float] = defaultdict(float)
    for r in rows:
        p = post[r["kind"], r["votes"]]
        for y, q in ((1, p), (0, 1 - p)):
            mass[r["kind"], y] += r["n"] * q
            for f in FEATURES:
                seen[f"{r['kind']}|{f}|{r[f]}", y] += r["n"] * q
    weights = {f"{k}|prior|": math.log((mass[k, 1] + 1) / (mass[k, 0] + 1)) for k in KINDS}
    for key in {k for k, _ in seen}:
        kind = key.split("|")[0]
        weights[key] = math.log((seen[key, 1] + 1) / (mass[kind, 1] + 6)) - math.log((seen[key, 0] + 1) / (mass[kind, 0] + 6))
    return weights


def decided(found: Column, weights: dict[str, float]) -> Column:
    """Base spans and the wider ones that the classifier takes, by kind and start."""
    known = F.create_map(*[F.lit(x) for pair in sorted(weights.items()) for x in pair])

    def weight(kind: Column, feature: str, value: Column) -> Column:
        return F.coalesce(F.element_at(known, F.concat_ws("|", kind, F.lit(feature), value)), F.lit(0.0))

    def taken(s: Column) -> Column:
        score = weight(s["kind"], "prior", F.lit(""))
        for f in FEATURES:
            score = score + weight(s["kind"], f, s[f])
        return s["base"] | (score > 0)

    return F.array_sort(F.filter(found, taken))


def find(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, the four counts and the digest of the base spans, and all spans."""
    found = settle(candidates(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).drop("text"), "found")
    weights = train(found)
    base = F.filter("found", lambda s: s["base"])
    rows = found.withColumns({"base": F.coalesce(base, F.array()), "spans": F.coalesce(decided(F.col("found"), weights), F.array())})
    counts = [F.size(F.filter("base", _of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS]
    return rows.select(
        "doc_id", *counts, F.sha2(span_text(F.array_sort("base")), 256).alias("base_sha256"), span_text(F.col("spans")).alias("spans")
    )


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def redact(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in angle brackets; overlapping spans become one."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(state: Column, s: Column) -> Column:
        end = -s["end"]
        piece = F.when(
            s["start"] >= state["at"],
            F.array(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))),
        ).otherwise(F.array().cast("array<string>"))
        return F.struct(F.greatest(state["at"], end).alias("at"), F.concat(state["parts"], piece).alias("parts"))

    def done(state: Column) -> Column:
        return F.concat(F.array_join(state["parts"], ""), F.substring(text, state["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(ordered, start, step, done)).otherwise(text)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind; ``n_chars`` follows the new text."""
    docs = only(docs, DOCUMENTS)
    weights = train(settle(candidates(docs.select("text")).select("found").where(F.col("found").isNotNull()), "found"))
    rows = candidates(docs).withColumn("found", decided(F.col("found"), weights))
    rows = rows.withColumn("text", F.when(F.col("found").isNotNull(), redact(F.col("text"), F.col("found"))).otherwise(F.col("text")))
    return rows.withColumn("n_chars", F.when(F.col("found").isNotNull(), F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*DOCUMENTS)


def query(spark, sf_dir: str) -> DataFrame:
    return find(table(spark, sf_dir, "documents"))
