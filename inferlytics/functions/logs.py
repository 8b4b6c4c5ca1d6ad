"""Metrics from the summary text of a benchmark run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: metric name and the labels of its lines -------------------------
LOG_LABELS = {
    "samples_per_second": ["Samples per second", "samples per second", "Completed samples per second", "Completed Samples per second"],
    "tokens_per_second": ["Tokens per second", "tokens per second", "Completed tokens per second", "Completed Tokens per second"],
    "mean_latency_ns": ["Mean latency (ns)"],
    "p50_latency_ns": ["50.00 percentile latency (ns)"],
    "p90_latency_ns": ["90.00 percentile latency (ns)"],
    "p99_latency_ns": ["99.00 percentile latency (ns)"],
    "min_first_token_latency_ns": ["Min First Token latency (ns)"],
    "max_first_token_latency_ns": ["Max First Token latency (ns)"],
    "mean_first_token_latency_ns": ["Mean First Token latency (ns)"],
    "p50_first_token_latency_ns": ["50.00 percentile first token latency (ns)"],
    "p90_first_token_latency_ns": ["90.00 percentile first token latency (ns)"],
    "p95_first_token_latency_ns": ["95.00 percentile first token latency (ns)"],
    "p97_first_token_latency_ns": ["97.00 percentile first token latency (ns)"],
    "p99_first_token_latency_ns": ["99.00 percentile first token latency (ns)"],
    "p99_9_first_token_latency_ns": ["99.90 percentile first token latency (ns)"],
    "min_tpot_ns": ["Min Time to Output Token (ns)"],
    "max_tpot_ns": ["Max Time to Output Token (ns)"],
    "mean_tpot_ns": ["Mean Time to Output Token (ns)"],
    "p50_tpot_ns": ["50.00 percentile time to output token (ns)"],
    "p90_tpot_ns": ["90.00 percentile time to output token (ns)"],
    "p95_tpot_ns": ["95.00 percentile time to output token (ns)"],
    "p97_tpot_ns": ["97.00 percentile time to output token (ns)"],
    "p99_tpot_ns": ["99.00 percentile time to output token (ns)"],
    "p99_9_tpot_ns": ["99.90 percentile time to output token (ns)"],
}
VALID_TEXT = "Result is : VALID"
COMPLETE_TEXT = "Early stopping satisfied"
# --- end of fixed values ----------------------------------------------------------

#: A line of a label, a colon and a number; an exponent is read by ``strict`` only.
PLAIN_LINE = r"(?m)^([^:\n]*):[ \t]*([0-9.]+)"
FULL_LINE = r"(?m)^([^:\n]*):[ \t]*([0-9.]+(?:[eE][-+]?[0-9]+)?)"


def log_lines(text: Column, strict: bool = False) -> Column:
    """The lines that have a label and a number, in the order of the text. Each holds one colon."""
    return F.regexp_extract_all(text, F.lit(FULL_LINE if strict else PLAIN_LINE), F.lit(0))


def line_number(line: Column) -> Column:
    return F.ltrim(F.substring_index(line, ":", -1), F.lit(" \t")).try_cast("double")


def _first_place(labels: Column, wanted: list[str]) -> Column:
    """Place from 1 of the first label that is wanted; 0 if there is none."""
    places = [F.array_position(labels, label) for label in wanted]
    if len(places) == 1:
        return places[0]
    return F.coalesce(F.least(*[F.nullif(p, F.lit(0)) for p in places]), F.lit(0))


def extract_log_metrics(df: DataFrame, text: str = "text", strict: bool = False, total: Column | None = None) -> DataFrame:
    """Add 24 metrics, ``valid``, ``total_samples`` and ``completed`` to a table of logs.

    The text is searched once for lines of a label and a number; only a metric's own line is cut further. A metric is the
    number of its first line. By default an exponent is not read (``1.2e+06`` gives 1.2); ``strict`` reads it. A number that is none gives null.
    """
    total = F.coalesce(total if total is not None else F.lit(0), F.lit(0)).cast("long")
    body = F.col(text)
    lines = df.withColumn("_lines", log_lines(body, strict))
    lines = lines.withColumn("_labels", F.transform("_lines", lambda s: F.trim(F.substring_index(s, ":", 1))))

    def metric(wanted: list[str]) -> Column:
        return line_number(F.get("_lines", (_first_place(F.col("_labels"), wanted) - 1).cast("int")))

    return lines.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[metric(wanted).alias(name) for name, wanted in LOG_LABELS.items()],
        body.contains(VALID_TEXT).alias("valid"),
        F.when(body.contains(COMPLETE_TEXT), total).otherwise(F.lit(0)).alias("completed"),
        total.alias("total_samples"),
    )
