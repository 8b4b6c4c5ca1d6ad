"""Predicates and row filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hardware import within_tolerance  # noqa: F401  (part of the filter surface)
from ..schema import feature_kind, qcol

TOKENS = "Tokens/s"


def is_finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def valid_submissions(df: DataFrame) -> DataFrame:
    """Token throughput rows with a usable result and at least one accelerator."""
    result = qcol("metrics.result")
    return df.where(
        (qcol("metrics.units") == TOKENS)
        & result.isNotNull()
        & (result != 0)
        & is_finite(result)
        & (qcol("system.accelerator.total_count") > 0)
    )


def tokens_only(df: DataFrame) -> DataFrame:
    """Units filter alone; null results survive."""
    return df.where(qcol("metrics.units") == TOKENS)


def _member(df: DataFrame, col: str, wanted) -> DataFrame:
    if isinstance(wanted, DataFrame):
        return df.join(wanted.select(F.col(wanted.columns[0]).alias("_wanted")), qcol(col) == F.col("_wanted"), "left_semi")
    return df.where(qcol(col).isin(list(wanted)))


def select_runs(df: DataFrame, model: str, submitters, accelerators) -> DataFrame:
    """Runs of one model by chosen submitters on chosen accelerators.

    The choices are lists, or one-column tables that are semi-joined. A null name is in
    no list, so such rows never qualify.
    """
    picked = _member(df.where(qcol("model.name") == model), "submission.organization", submitters)
    return _member(picked, "system.accelerator.name", accelerators)


def similar_configurations(df: DataFrame, query: dict, tol: float = 0.1) -> DataFrame:
    """Rows near a query: a band around continuous features, equality on the rest.

    Criteria that are None are skipped. The band ``v(1-t) .. v(1+t)`` is empty for v < 0.
    """
    for name, value in query.items():
        if value is None:
            continue
        if feature_kind(name) == "continuous":
            df = df.where(qcol(name).between(value * (1 - tol), value * (1 + tol)))
        else:
            df = df.where(qcol(name) == value)
    return df


def systems_for(df: DataFrame, gpu: str, count: int) -> DataFrame:
    return df.where(
        (qcol("system.accelerator.name") == gpu) & (qcol("system.total_accelerators") == count)
    )


def successful_requests(df: DataFrame) -> DataFrame:
    return df.where(F.col("output_tokens") > 0)


def vocabulary_filter(ids: Column, vocab_size: int) -> Column:
    """Token ids from 0 to ``vocab_size``, both ends included."""
    return F.filter(ids, lambda t: (t >= 0) & (t <= vocab_size))


def validate_run_configs(df: DataFrame) -> DataFrame:
    """Add ``violations`` (rule codes) and the effective remote model path, if there is one."""
    scenario, mode = F.col("scenario"), F.col("mode")
    sweep = F.coalesce(F.col("sweep"), F.lit(False))
    rules = {
        "output_column_required": mode.isin("accuracy", "all") & (F.coalesce(F.col("output_column"), F.lit("")) == ""),
        "rate_or_sweep_required": scenario.isin("Offline", "Server") & ~sweep & F.col("target_qps").isNull(),
        "server_without_batch_size": (scenario == "Server") & F.col("batch_size").isNotNull(),
        "single_stream_without_accuracy": (scenario == "SingleStream") & (mode == "accuracy"),
        "sweep_without_accuracy": sweep & mode.isin("accuracy", "all"),
    }
    codes = F.array_compact(F.array(*[F.when(broken, F.lit(code)) for code, broken in rules.items()]))
    out = df.withColumn("violations", codes)
    if {"remote_model_path", "model_path"} <= set(df.columns):
        out = out.withColumn("remote_model_path", F.coalesce("remote_model_path", "model_path"))
    return out
