"""Mixing sources to target weights: hierarchical token budgets over a domain, language, source tree.

A node's budget is divided among its children by weight. A child that cannot use its share (tokens at hand times the
allowed epochs) gets what it can use and the rest goes to its siblings by weight; only when all siblings are full does a
shortage reach the level above, because a node never gets more than its whole subtree can use. Shares are whole tokens,
rounded down.

A leaf reads its documents in the order of a seeded hash, anew for each epoch. Whole epochs take every document; of the
last one the longest prefix that fits the rest of the budget is taken (nothing, if the epochs use it up). The hash space is counted in 65,536 ranges first,
so a leaf with a third of all rows is never ordered in one task: only the one range where the budget ends is.

Nulls and odd input: null domain, language or source is the node ''; leaves that the tree does not name, and weights that
are null or not positive, get nothing. A null text has no tokens. Rows equal in id and text are drawn one by one. Empty
tables give empty results; extra columns are ignored. Only DataFrame functions are used.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferlytics.llm.common import DOCUMENTS, only, settle, table, text_key

LEVELS = ("domain", "lang", "source")
SALTS = 64
SEED = 7
EPOCHS = 3
WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def divide(nodes: DataFrame, parents: Sequence[str], key: str) -> DataFrame:
    """Budget of each child: columns ``weight``, ``capacity`` and the parent's ``budget`` in, the child's ``budget`` out.

    Children fill up in the order of capacity by weight; those whose capacity is below their share of what is left are
    full, the others share the rest by weight.
    """
    family = Window.partitionBy(*parents)
    order = family.orderBy("ratio", key)
    big, small = "decimal(28,0)", "decimal(9,0)"
    rows = nodes.withColumns(
        {
            "capacity": F.col("capacity").cast(big),
            "weight": F.col("weight").cast(small),
            "budget": F.col("budget").cast(big),
            "ratio": F.col("capacity").cast("double") / F.col("weight").cast("double"),
        }
    )
    rows = rows.withColumns(
        {
            "before": F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast(big),
            "open": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)).cast(small),
        }
    )
    rows = rows.withColumn("full", F.expr("capacity * open <= (budget - before) * weight"))
    rows = rows.withColumns(
        {
            "rest": (F.col("budget") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(family), F.lit(0))).cast(big),
            "shares": F.sum(F.when(~F.col("full"), F.col("weight"))).over(family).cast(small),
        }
    )
    budget = F.when(F.col("full"), F.col("capacity").cast("long")).otherwise(F.expr("(rest * weight) div shares"))
    return rows.select(*parents, key, budget.alias("budget"))


def leaf_budgets(leaves: DataFrame, total: Column | int, epochs: int = EPOCHS) -> DataFrame:
    """(domain, lang, source, budget) from leaves with ``tokens`` at hand and the weights of their three levels."""
    weights = [f"{level}_weight" for level in LEVELS]
    used = leaves.where(" AND ".join(f"{w} > 0" for w in weights)).withColumn("capacity", F.col("tokens") * epochs)
    domains = used.groupBy("domain").agg(F.sum("capacity").alias("capacity"), F.max("domain_weight").alias("weight"))
    root = domains.withColumn("all", F.lit(1)).withColumn("budget", F.sum("capacity").over(Window.partitionBy("all")))
    root = root.withColumn("budget", F.least("budget", total if isinstance(total, Column) else F.lit(total)))
    by_domain = divide(root, ["all"], "domain").drop("all")
    langs = used.groupBy("domain", "lang").agg(F.sum("capacity").alias("capacity"), F.max("lang_weight").alias("weight"))
    by_lang = divide(langs.join(by_domain, "domain"), ["domain"], "lang")
    sources = used.groupBy(*LEVELS).agg(F.sum("capacity").alias("capacity"), F.max("source_weight").alias("weight"))
    return divide(sources.join(by_lang, ["domain", "lang"]), ["domain", "lang"], "source")


def _beside_leaves(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """Join rows with a small table by leaf; rows of a frequent leaf are dealt over ``SALTS`` keys."""
    copies = leaves.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int")).join(copies, [*LEVELS, "salt"]).drop("salt")


def mix(rows: DataFrame, tree: DataFrame, total: int | None = None, share: tuple[int, int] = (1, 2), epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """doc_id, text_key, domain, lang, source, tokens, copies of the selected documents.

    ``rows``: doc_id, text_key, domain, lang, source, tokens. ``tree``: the three levels and ``domain_weight``,
    ``lang_weight``, ``source_weight`` (whole numbers). ``total`` tokens are drawn, by default ``share`` of those at hand.
    """
    names = {level: F.coalesce(F.col(level), F.lit("")) for level in LEVELS}
    rows = settle(rows.select("doc_id", "text_key", "tokens", *[c.alias(n) for n, c in names.items()]), "rows")
    tree = tree.select(*[c.alias(n) for n, c in names.items()], *[f"{level}_weight" for level in LEVELS])
    supply = settle(rows.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens")), "supply")
    if total is None:
        total = (supply.agg(F.sum("tokens")).first()[0] or 0) * share[0] // share[1]
    budgets = leaf_budgets(supply.where("tokens > 0").join(tree.dropDuplicates(list(LEVELS)), list(LEVELS)), total, epochs)
    leaves = budgets.join(supply, list(LEVELS)).select(
        *LEVELS, F.expr("budget div tokens").alias("whole"), F.expr("budget % tokens").alias("rest")
    )
    leaves = settle(leaves.where("whole > 0 OR rest > 0"), "leaves")
    place = F.md5(F.concat_ws(":", F.lit(seed), "whole", "doc_id"))
    drawn = settle(_beside_leaves(rows, leaves).withColumn("place", place), "drawn")
    part = F.conv(F.substring("place", 1, 4), 16, 10).cast("int").alias("part")
    ranges = drawn.groupBy(*LEVELS, part).agg(F.sum("tokens").alias("t"), F.first("rest").alias("rest"))
    so_far = ranges.withColumn("upto", F.sum("t").over(Window.partitionBy(*LEVELS).orderBy("part")))
    edges = (
        so_far.where(F.col("upto") > F.col("rest"))
        .groupBy(*LEVELS)
        .agg(F.min("part").alias("edge"), F.min(F.struct("part", (F.col("upto") - F.col("t")).alias("before")))["before"].alias("before"))
    )
    near = _beside_leaves(drawn.withColumn("part", part), edges)
    order = Window.partitionBy(*LEVELS).orderBy("place", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    last = near.where(F.col("part") == F.col("edge")).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    columns = ["doc_id", "text_key", *LEVELS, "tokens"]
    both = near.where(F.col("part") != F.col("edge")).select(
        *columns, (F.col("whole") + ((F.col("part") < F.col("edge")) & (F.col("rest") > 0)).cast("int")).alias("copies")
    ).union(last.select(*columns, (F.col("whole") + ((F.col("upto") <= F.col("rest")) & (F.col("rest") > 0)).cast("int")).alias("copies")))
    return both.where("copies > 0").select(*columns, F.col("copies").cast("int").alias("copies"))


def document_rows(docs: DataFrame, domain: Column) -> DataFrame:
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        domain.alias("domain"),
        "lang",
        "source",
        word_tokens(F.col("text")).alias("tokens"),
    )


def source_domain() -> Column:
    """Domain of a source name like ``src12``: its number modulo four; other names are the domain ''."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), r"^src([0-9]{1,9})$", 1)
    return F.when(number != "", F.concat(F.lit("d"), (number.cast("int") % 4).cast("string"))).otherwise("")


def default_tree(docs: DataFrame) -> DataFrame:
    """Weights of the leaves that occur: domains d0 to d3 weigh 1 to 4 (others 1), English 4 and other languages 2, a
    source 1 to 3 by its number."""
    number = F.coalesce(F.regexp_extract(F.coalesce("source", F.lit("")), r"^src([0-9]{1,9})$", 1).try_cast("int"), F.lit(0))
    leaves = docs.select(source_domain().alias("domain"), "lang", "source").distinct()
    return leaves.select(
        "domain",
        "lang",
        "source",
        (1 + number % 4).alias("domain_weight"),
        F.when(F.col("lang") == "en", 4).otherwise(2).alias("lang_weight"),
        (1 + number % 3).alias("source_weight"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn to the weights, each as often as it was drawn, with their columns."""
    docs = only(docs, DOCUMENTS)
    drawn = mix(document_rows(docs, source_domain()), default_tree(docs), share=(9, 10))
    # rows equal in id and text lie in one leaf; each gets the copies of one of them
    drawn = drawn.withColumn("n", F.row_number().over(Window.partitionBy("doc_id", "text_key", *LEVELS[1:]).orderBy("copies")))
    keys = drawn.select(
        F.col("doc_id").alias("_id"), F.col("text_key").alias("_hash"), F.col("lang").alias("_lang"), F.col("source").alias("_source"), "n", "copies"
    )
    n = F.row_number().over(Window.partitionBy("doc_id", "_key", "lang", "source").orderBy("n_chars"))
    rows = docs.withColumn("_key", text_key(F.col("text"))).withColumn("_n", n)
    on = (
        (F.col("_key") == F.col("_hash"))
        & F.col("doc_id").eqNullSafe(F.col("_id"))
        & (F.coalesce("lang", F.lit("")) == F.col("_lang"))
        & (F.coalesce("source", F.lit("")) == F.col("_source"))
        & (F.col("_n") == F.col("n"))
    )
    return rows.join(keys, on).select(*DOCUMENTS, F.explode(F.sequence(F.lit(1), "copies")).alias("_copy")).drop("_copy")


def query(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mix(document_rows(docs, source_domain()), default_tree(docs)).drop("text_key")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE WHEN regexp_matches(coalesce(source, ''), '^src[0-9]{1,9}$')
      THEN 'd' || CAST(CAST(substr(source, 4) AS INTEGER) % 4 AS VARCHAR) ELSE '' END AS domain,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS tokens
  FROM documents
), leaf AS (
  SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens, CAST(sum(tokens) AS HUGEINT) * 3 AS capacity,
    1 + coalesce(TRY_CAST(substr(domain, 2) AS INTEGER), 0) AS dw, CASE WHEN lang = 'en' THEN 4 ELSE 2 END AS lw,
    1 + coalesce(TRY_CAST(regexp_extract(source, '^src([0-9]{1,9})$', 1) AS INTEGER), 0) % 3 AS sw
  FROM d GROUP BY domain, lang, source HAVING sum(tokens) > 0
), d1 AS (
  SELECT domain, sum(capacity) AS c, max(dw) AS w, least(sum(sum(capacity)) OVER (), (SELECT sum(tokens) FROM d) // 2) AS b FROM leaf GROUP BY domain
), d2 AS (
  SELECT *, coalesce(sum(c) OVER (ORDER BY c / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
    sum(w) OVER (ORDER BY c / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM d1
), d3 AS (
  SELECT domain, CASE WHEN f THEN CAST(c AS HUGEINT) ELSE (CAST(b AS HUGEINT) - CAST(coalesce(sum(c) FILTER (f) OVER (), 0) AS HUGEINT)) * w // CAST(sum(w) FILTER (NOT f) OVER () AS HUGEINT) END AS b
  FROM (SELECT *, c * op <= (b - bef) * w AS f FROM d2)
), l1 AS (
  SELECT domain, lang, sum(capacity) AS c, max(lw) AS w, any_value(b) AS b FROM leaf JOIN d3 USING (domain) GROUP BY domain, lang
), l2 AS (
  SELECT *, coalesce(sum(c) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
    sum(w) OVER (PARTITION BY domain ORDER BY c / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM l1
), l3 AS (
  SELECT domain, lang, CASE WHEN f THEN CAST(c AS HUGEINT) ELSE (CAST(b AS HUGEINT) - CAST(coalesce(sum(c) FILTER (f) OVER (PARTITION BY domain), 0) AS HUGEINT)) * w // CAST(sum(w) FILTER (NOT f) OVER (PARTITION BY domain) AS HUGEINT) END AS b
  FROM (SELECT *, c * op <= (b - bef) * w AS f FROM l2)
), s1 AS (
  SELECT domain, lang, source, tokens, capacity AS c, sw AS w, b FROM leaf JOIN l3 USING (domain, lang)
), s2 AS (
  SELECT *, coalesce(sum(c) OVER (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef,
    sum(w) OVER (PARTITION BY domain, lang ORDER BY c / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS op FROM s1
), s3 AS (
  SELECT domain, lang, source, tokens AS supply, CASE WHEN f THEN CAST(c AS HUGEINT) ELSE (CAST(b AS HUGEINT) - CAST(coalesce(sum(c) FILTER (f) OVER (PARTITION BY domain, lang), 0) AS HUGEINT)) * w // CAST(sum(w) FILTER (NOT f) OVER (PARTITION BY domain, lang) AS HUGEINT) END AS b
  FROM (SELECT *, c * op <= (b - bef) * w AS f FROM s2)
), p AS (
  SELECT doc_id, domain, lang, source, tokens, b // supply AS whole, b % supply AS rest,
    sum(tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat_ws(':', '7', CAST(b // supply AS VARCHAR), CAST(doc_id AS VARCHAR))) ROWS UNBOUNDED PRECEDING) AS upto
  FROM d JOIN s3 USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, CAST(tokens AS BIGINT) AS tokens, CAST(whole + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END AS INTEGER) AS copies
FROM p WHERE whole + CASE WHEN upto <= rest AND rest > 0 THEN 1 ELSE 0 END > 0
"""
