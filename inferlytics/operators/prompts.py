"""Prompt preparation: families, templates, length fitting, batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as tx


def model_family(df: DataFrame, path_col: str = "model_path", patterns=None, out: str = "family") -> DataFrame:
    return df.withColumn(out, tx.model_family(F.col(path_col), patterns))


def render_prompts(
    df: DataFrame,
    family: str | Column = "family",
    input_col: str = "input",
    system_col: str | None = "system_prompt",
    null_as: str = "",
    out: str = "prompt",
) -> DataFrame:
    """Chat prompt per row. Without a system column the default system prompt is used;
    a null system prompt reads as ``null_as``."""
    chosen = F.col(family) if isinstance(family, str) else family
    system = F.lit(tx.DEFAULT_SYSTEM_PROMPT) if system_col is None else F.coalesce(F.col(system_col), F.lit(null_as))
    return df.withColumn(out, tx.render(chosen, system, F.col(input_col)))


def fit_tokens(
    df: DataFrame,
    text: str,
    max_tokens: int,
    fixed: bool = False,
    pad: str = "<pad>",
    tokenizer: Callable[[pd.Series], pd.Series] | None = None,
    out: str = "fitted",
) -> DataFrame:
    """Cut each text to ``max_tokens``; with ``fixed`` pad shorter ones on the right.

    The default tokens are white-space separated words. A caller's ``tokenizer`` maps a
    series of texts to a series of fitted texts and runs as an Arrow function; it must apply
    ``max_tokens`` and ``fixed`` itself.
    """
    if tokenizer is not None:
        return df.withColumn(out, F.pandas_udf(tokenizer, T.StringType())(F.col(text)))
    tokens = F.slice(tx.words(F.col(text)), 1, max_tokens)
    if fixed:
        tokens = F.concat(tokens, F.array_repeat(F.lit(pad), F.lit(max_tokens) - F.size(tokens)))
    return df.withColumn(out, F.concat_ws(" ", tokens)).withColumn(
        "n_tokens", F.least(F.size(tx.words(F.col(text))), F.lit(max_tokens))
    )


def assign_batches(df: DataFrame, size: int | None, order: str = "sample_idx") -> DataFrame:
    """Consecutive batches by the stored index; no size means one batch."""
    batch = F.lit(0).cast("long") if size is None else F.floor(F.col(order) / size)
    return df.withColumn("batch_id", batch)


def limit_samples(df: DataFrame, n: int | None, order: str = "sample_idx") -> DataFrame:
    """First ``n`` samples by index; all without ``n``."""
    return df if n is None else df.where(F.col(order) < n)


def map_batches(
    df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str | T.StructType, batch: int | None = None
) -> DataFrame:
    """Apply a caller's batch function to slices of at most ``batch`` rows of each partition."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            step = batch or max(len(frame), 1)
            for start in range(0, len(frame), step):
                yield fn(frame.iloc[start : start + step])

    return df.mapInPandas(run, schema)
