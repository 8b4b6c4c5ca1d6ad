"""End-to-end plans: dataset cleaning, dashboard table, accuracy evaluation, run merge."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import sentence_lines
from ..operators import accuracy as acc
from ..operators import boards, clean, enrich, filters, runs
from ..operators.ranks import settled
from ..schema import conform, qcol
from ..sources.readers import read_run_directories


def etl(df: DataFrame, frameworks: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Raw result table (canonical names) to the clean, typed, enriched result table.

    One chain of projections and a filter: no shuffle. All framework versions are in the map
    ``software.framework.versions``; those named in ``frameworks`` also get a column each.
    """
    # Cleaned before the missing columns come, whose nulls then stay constants in all later rules.
    typed = (
        clean.clean_strings(df)
        .transform(conform)
        .transform(clean.normalize_memory)
        .transform(clean.normalize_datetime)
        .transform(clean.normalize_frequency)
        .transform(clean.cast_columns, strict=strict)
        .transform(enrich.add_vendors)
        .transform(clean.normalize_interconnect)
    )
    return (
        enrich.framework_wide(typed, frameworks)
        .transform(enrich.framework_map)
        .transform(enrich.model_parameters)
        .transform(enrich.model_architecture)
        .transform(enrich.total_accelerators)
        .transform(enrich.result_per_accelerator)
        .transform(clean.sort_columns)
        .transform(filters.valid_submissions)
    )


def dashboard(df: DataFrame, prices: DataFrame, default_price: float | None = None) -> DataFrame:
    """Result table with totals, prices, tokens/s, costs and the accuracy map."""
    priced = enrich.total_accelerators(df, null_policy="one").transform(
        enrich.with_prices, prices, default_price
    )
    return (
        priced.transform(enrich.system_price)
        .transform(filters.tokens_only)
        .transform(enrich.cost_columns)
        .transform(enrich.parse_accuracy)
    )


def best_then_price(df: DataFrame, prices: DataFrame, keys: list[str], default_price: float | None = None) -> DataFrame:
    """Dashboard rows of the best result per group, priced after the choice.

    A price does not change which result is fastest, so the table is first reduced to one
    row per group, before any shuffle, and only the winners meet the prices. The board views
    give the same rows on this table as on the whole dashboard table of the same keys.
    """
    totals = enrich.total_accelerators(df, null_policy="one").transform(filters.tokens_only)
    carried = [
        "model.name", "submission.scenario", "system.name", "submission.organization", enrich.ACCELERATOR,
        "system.total_accelerators", "metrics.result", "metrics.units", "submission.debug_uid",
    ]
    best = boards.best_per_group(view_columns(totals, carried), keys, metric="metrics.result")
    return (
        best.transform(enrich.with_prices, prices, default_price)
        .transform(enrich.system_price)
        .transform(enrich.cost_columns)
    )


def accuracy_evaluation(
    log: DataFrame, refs: DataFrame, vocab: DataFrame, vocab_size: int,
    key: str = "log_id", sep: str = "", stem: bool = True, lcs: bool = True, dedupe_references: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Per-sample scores and the corpus record of an accuracy log.

    ``log`` is (log_id, qsl_idx, data), ``refs`` (sample_idx, input, reference, system_prompt).
    The indices are matched before anything is decoded. Decoding and scoring run once: references, predictions and scores
    are written to the shared folder, and both results read them there. A reference's texts are not copied for each of its
    samples; they join the details at the end.
    """
    refs = settled(refs, "references")
    wanted = refs.select("sample_idx", "reference") if dedupe_references else refs.select("sample_idx").distinct()
    matched = acc.pair_predictions(log.where(F.col(key).isNotNull()), wanted, dedupe_references, key).drop("reference")
    carry = [c for c in log.columns if c not in (key, "data")]
    decoded = acc.decode_hex_ids(matched, vocab_size=vocab_size)
    texts = acc.decode_tokens(decoded, vocab, key, sep=sep, out="prediction", vocab_size=vocab_size, carry=carry)
    samples = settled(acc.normalize_sentences(texts, ["prediction"]), "samples")
    targets = refs.select("sample_idx", sentence_lines(F.col("reference")).alias("target"))
    others = [c for c in carry if c != "qsl_idx"]
    scores = settled(acc.scores_by_reference(samples, targets, key, [*others, "prediction", "n_tokens"], stem, lcs), "scores")
    details = scores.join(refs, F.col("qsl_idx") == F.col("sample_idx"))
    percents = acc.percent_columns(scores)
    names = [*carry, *[c for c in refs.columns if c != "sample_idx"], "prediction", "n_tokens"]
    return details.select(key, *names, *percents), acc.corpus_record(scores)


def aggregate_runs(spark: SparkSession, base: str, published: DataFrame | None = None) -> DataFrame:
    """Merged run directories below ``base``, after the published table if there is one."""
    perf, accuracy, results, listing = read_run_directories(spark, base)
    merged = runs.merge_runs(perf, accuracy, results, listing)
    return merged if published is None else runs.combine(published, merged)


def view_columns(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[qcol(n) for n in names])
