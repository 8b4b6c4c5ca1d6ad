"""Derived columns: vendors, frameworks, model facts, counts, prices, costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hardware as hw
from ..schema import qcol
from .ranks import settled

ACCELERATOR = "system.accelerator.name"

SMALL_PRICE_LIST = 100_000  # names, a few MB
SALTS = 64


def classify_by_keyword(
    df: DataFrame, col: str, rules: list[tuple[str, list[str]]], out: str
) -> DataFrame:
    return df.withColumn(out, hw.keyword_class(qcol(col), rules))


def add_vendors(df: DataFrame) -> DataFrame:
    df = classify_by_keyword(df, ACCELERATOR, hw.ACCELERATOR_VENDORS, "system.accelerator.vendor")
    return classify_by_keyword(df, "system.cpu.model", hw.CPU_VENDORS, "system.cpu.vendor")


def framework_versions(df: DataFrame, col: str = "software.framework") -> DataFrame:
    """Add ``frameworks``: array<struct<name, version>> in the order of the text."""
    return df.withColumn("frameworks", hw.framework_entries(qcol(col)))


def framework_map(df: DataFrame, col: str = "software.framework", out: str | None = None) -> DataFrame:
    """Add ``software.framework.versions``: map of every framework name of the row to its first version.

    Names are an open set, so they are keys and not columns: a table may have any number of them.
    """
    entries = df.withColumn("_entries", F.reverse(hw.framework_entries(qcol(col))))
    return entries.withColumn(out or f"{col}.versions", hw.entries_to_map(F.col("_entries"), "name", "version")).drop("_entries")


def framework_wide(df: DataFrame, names: Sequence[str], col: str = "software.framework") -> DataFrame:
    """One ``software.framework.<name>`` column per wanted name, first version of the row wins.

    The versions are looked up inside the row, so neither a row id nor a join is needed.
    """
    if not names:
        return df
    base = df.withColumn("_entries", hw.framework_entries(qcol(col)))
    return base.select(
        *[qcol(c) for c in df.columns],
        *[_version_of(F.col("_entries"), n).alias(f"{col}.{n}") for n in names],
    )


def _version_of(entries: Column, name: str) -> Column:
    return F.get(F.filter(entries, lambda e: e["name"] == name), F.lit(0))["version"]


def model_parameters(df: DataFrame, col: str = "model.name") -> DataFrame:
    return df.withColumn("model.number_of_parameters", hw.model_parameters(qcol(col)))


def model_architecture(df: DataFrame, col: str = "model.name") -> DataFrame:
    return df.withColumn("model.architecture", hw.model_architecture(qcol(col)))


def total_accelerators(df: DataFrame, null_policy: str = "propagate", out: str | None = None) -> DataFrame:
    """Nodes times accelerators per node; a missing factor gives null or counts as one."""
    nodes, per_node = qcol("system.number_of_nodes"), qcol("system.accelerator.count_per_node")
    if null_policy == "one":
        nodes, per_node = F.coalesce(nodes, F.lit(1)), F.coalesce(per_node, F.lit(1))
        out = out or "system.total_accelerators"
    elif null_policy != "propagate":
        raise ValueError(f"unknown null_policy {null_policy!r}")
    return df.withColumn(
        out or "system.accelerator.total_count",
        F.try_multiply(nodes.cast("long"), per_node.cast("long")),
    )


def result_per_accelerator(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "metrics.result_per_accelerator",
        F.try_divide(qcol("metrics.result"), qcol("system.accelerator.total_count")),
    )


def tokens_per_accelerator(df: DataFrame) -> DataFrame:
    """Tokens/s per accelerator, 0.0 where the count is 0 or unknown."""
    total = qcol("system.total_accelerators")
    share = F.try_divide(qcol("result.tokens_per_second"), total)
    return df.withColumn(
        "result.tokens_per_accelerator",
        F.when(total.isNull() | (total == 0), F.lit(0.0)).otherwise(share),
    )


def with_prices(df: DataFrame, prices: DataFrame, default_price: float | None = None, small: int = SMALL_PRICE_LIST) -> DataFrame:
    """Left join of unit prices by exact accelerator name; unmatched rows keep null.

    ``prices`` (name, price_per_hour) is reduced to one row per name first, so the join
    never multiplies rows. Its names are counted: up to ``small`` of them are broadcast, so
    the results are not shuffled; a longer list meets them by (name, salt), which spreads
    rows of frequent names and rows without a name. The reduced list is written once, for the
    count and the join; of repeated names the highest price counts.
    """
    unit = settled(prices.groupBy("name").agg(F.max("price_per_hour").alias("accelerator.price_per_hour")), "prices")
    if unit.count() <= small:
        out = df.join(F.broadcast(unit), qcol(ACCELERATOR) == F.col("name"), "left").drop("name")
    else:
        flat = [qcol(c) for c, kind in df.dtypes if not kind.startswith(("map<", "array<", "struct<"))]
        copies = unit.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salted = df.withColumn("_salt", F.pmod(F.xxhash64(*flat), F.lit(SALTS)))
        on = (qcol(ACCELERATOR) == F.col("name")) & (F.col("_salt") == F.col("_copy"))
        out = salted.join(copies, on, "left").drop("name", "_salt", "_copy")
    if default_price is None:
        return out
    return out.withColumn(
        "accelerator.price_per_hour",
        F.coalesce(qcol("accelerator.price_per_hour"), F.lit(float(default_price))),
    )


def unpriced_accelerators(df: DataFrame, prices: DataFrame) -> DataFrame:
    """Accelerator names without a price and their row counts (counted before the join)."""
    return (
        df.where(qcol(ACCELERATOR).isNotNull())
        .groupBy(qcol(ACCELERATOR).alias(ACCELERATOR))
        .agg(F.count(F.lit(1)).alias("rows"))
        .join(prices.select("name"), qcol(ACCELERATOR) == F.col("name"), "left_anti")
    )


def system_price(df: DataFrame) -> DataFrame:
    return df.withColumn(
        "system.price_per_hour",
        qcol("system.total_accelerators") * qcol("accelerator.price_per_hour"),
    )


def cost_columns(df: DataFrame) -> DataFrame:
    """Tokens/s and cost per million tokens.

    ``result.cost_per_million_tokens`` is price per hour / tokens per second * 10^6, the
    customary dashboard figure, in which the hour is not converted to seconds.
    ``usd_per_million_tokens`` is the same figure in real dollars (divided by 3600).
    """
    price, tokens = qcol("system.price_per_hour"), qcol("metrics.result")
    cost = F.try_divide(price, tokens) * F.lit(1_000_000)
    return df.select(
        "*",
        tokens.alias("result.tokens_per_second"),
        cost.alias("result.cost_per_million_tokens"),
        (cost / 3600).alias("usd_per_million_tokens"),
    )


def parse_accuracy(df: DataFrame, col: str = "metrics.accuracy") -> DataFrame:
    """Add ``metrics.accuracy.structured``: map of lower-case metric name to value."""
    entries = df.withColumn("_entries", hw.accuracy_entries(qcol(col)))
    return entries.withColumn("metrics.accuracy.structured", hw.entries_to_map(F.col("_entries"))).drop("_entries")


def apply_price_overrides(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Merged price table: name, price_per_hour, old_price, changed.

    An override wins. ``changed`` marks overrides that are new or differ from the old price.
    """
    old = base.select("name", F.col("price_per_hour").alias("old_price"), F.lit(True).alias("_known"))
    new = overrides.select("name", F.col("price_per_hour").alias("new_price"), F.lit(True).alias("_set"))
    return old.join(new, "name", "full_outer").select(
        "name",
        F.when(F.col("_set"), F.col("new_price")).otherwise(F.col("old_price")).alias("price_per_hour"),
        "old_price",
        F.coalesce(F.col("_set") & ~F.col("old_price").eqNullSafe(F.col("new_price")), F.lit(False)).alias("changed"),
    )


def price_changes(merged: DataFrame) -> DataFrame:
    """Changed entries only, as (name, old_price, price_per_hour)."""
    return merged.where("changed").select("name", "old_price", "price_per_hour")
