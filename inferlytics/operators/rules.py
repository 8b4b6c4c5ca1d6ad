"""Wildcard rules and service-level verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ANY = "*"


def resolve_rules(runs: DataFrame, rules: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Effective rules of every (model, scenario) that occurs in ``runs``.

    ``rules``: model, scenario, key, value, and optionally ``layer`` (a higher layer, such as
    the user's file over the base file, wins outright). Within a layer an exact model beats
    the wildcard, then an exact scenario does. Only the distinct pairs are matched; each
    looks up its four possible patterns by equality, so no range or cross join arises.
    """
    if "layer" not in rules.columns:
        rules = rules.withColumn("layer", F.lit(0))
    if keys is not None:
        rules = rules.where(F.col("key").isin(keys))
    pairs = runs.select("model", "scenario").distinct()
    patterns = pairs.select(
        F.col("model").alias("_model"),
        F.col("scenario").alias("_scenario"),
        F.explode(
            F.array(
                *[
                    F.struct(m.alias("model"), s.alias("scenario"))
                    for m in (F.col("model"), F.lit(ANY))
                    for s in (F.col("scenario"), F.lit(ANY))
                ]
            )
        ).alias("p"),
    ).select("_model", "_scenario", "p.model", "p.scenario").distinct()
    strength = F.struct("layer", F.col("model") != ANY, F.col("scenario") != ANY)
    return (
        patterns.join(rules, ["model", "scenario"])
        .groupBy(F.col("_model"), F.col("_scenario"), "key")
        .agg(F.max_by("value", strength).alias("value"))
        .select(F.col("_model").alias("model"), F.col("_scenario").alias("scenario"), "key", "value")
    )


LIMIT_KEYS = ["ttft_latency", "tpot_latency", "target_latency", "target_latency_percentile"]


def _by_percentile(fraction: Column, columns: dict[float, Column]) -> Column:
    case = None
    for p, c in columns.items():
        case = F.when(fraction == p, c) if case is None else case.when(fraction == p, c)
    return case


def slo_report(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """Limits, measured percentiles, margins and a verdict per run.

    ``metrics`` has run_id, model, scenario, and in nanoseconds ``p90/p99_latency_ns`` and
    ``p90/p99/p99_9_first_token_latency_ns`` and ``.._tpot_ns``. Limits are in milliseconds.
    The rule ``target_latency_percentile`` picks the percentile (default 99). A request
    latency limit applies only when it is above zero; a limit that is absent is met.
    """
    resolved = resolve_rules(metrics, rules, LIMIT_KEYS)
    wide = resolved.groupBy("model", "scenario").agg(
        *[F.max(F.when(F.col("key") == k, F.col("value"))).alias(k) for k in LIMIT_KEYS]
    )
    joined = metrics.join(wide, ["model", "scenario"], "left").withColumn(
        "target_latency_percentile", F.coalesce("target_latency_percentile", F.lit(99.0))
    )
    p = F.col("target_latency_percentile")

    def measured(name: str) -> Column:
        known = {90.0: f"p90_{name}", 99.0: f"p99_{name}", 99.9: f"p99_9_{name}"}
        return _by_percentile(p, {k: F.col(c) for k, c in known.items() if c in metrics.columns}) / 1e6

    limits = {
        "ttft": (measured("first_token_latency_ns"), F.col("ttft_latency")),
        "tpot": (measured("tpot_ns"), F.col("tpot_latency")),
        "latency": (measured("latency_ns"), F.when(F.col("target_latency") > 0, F.col("target_latency"))),
    }
    out, ok = [], F.lit(True)
    for name, (value, limit) in limits.items():
        out += [value.alias(f"{name}_ms"), limit.alias(f"{name}_limit_ms"), (limit - value).alias(f"{name}_margin_ms")]
        ok = ok & (limit.isNull() | F.coalesce(value <= limit, F.lit(False)))
    return joined.select("run_id", "model", "scenario", "target_latency_percentile", *out, ok.alias("valid"))
