"""Request and token latency metrics, progress marks, sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import MOST_VALUES, approx_percentiles, equal_cuts, exact_percentiles, group_rank

NS = 1e9

LATENCY_PROBS = {"p50": 0.5, "p90": 0.9, "p99": 0.99}
TOKEN_PROBS = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p97": 0.97, "p99": 0.99, "p99_9": 0.999}


def request_duration(start: str = "start_ts", latency: str = "latency_s") -> Column:
    """Run duration in seconds: last end minus first start over all requests of the run."""
    start_s = F.unix_micros(F.col(start)) / 1e6
    return F.max(start_s + F.col(latency)) - F.min(start_s)


def request_metrics(
    df: DataFrame,
    run_keys: list[str] = ["run_id"],
    duration: Column | None = None,
    approx: bool = False,
) -> DataFrame:
    """Throughput and latency per run, over requests with output.

    ``duration`` is an aggregate giving the run's seconds. A run without success gets zeros
    and ``valid`` false. Counts and sums come from one pre-aggregated pass; percentiles are
    exact unless ``approx``.
    """
    ok = F.col("output_tokens") > 0
    latency_ns = F.col("latency_s") * NS
    seconds = F.col("_seconds")
    totals = df.groupBy(*run_keys).agg(
        F.count_if(ok).alias("completed"),
        F.count(F.lit(1)).alias("total_samples"),
        F.sum(F.when(ok, F.col("prompt_len") + F.col("output_tokens"))).alias("_tokens"),
        F.avg(F.when(ok, latency_ns)).alias("mean_latency_ns"),
        (duration if duration is not None else request_duration()).alias("_seconds"),
    )
    percentiles = approx_percentiles if approx else exact_percentiles
    spread = percentiles(df.where(ok), run_keys, {"latency_ns": latency_ns}, LATENCY_PROBS)
    zero = F.lit(0.0)
    return (
        totals.join(spread, run_keys, "left")
        .select(
            *run_keys,
            (F.col("completed") > 0).alias("valid"),
            "completed",
            "total_samples",
            F.coalesce(F.try_divide(F.col("completed"), seconds), zero).alias("samples_per_second"),
            F.coalesce(F.try_divide(F.col("_tokens"), seconds), zero).alias("tokens_per_second"),
            *[F.coalesce(c, zero).alias(c) for c in ["mean_latency_ns", "p50_latency_ns", "p90_latency_ns", "p99_latency_ns"]],
        )
    )


def non_empty_chunks(chunks: DataFrame) -> DataFrame:
    return chunks.where(F.length("text") > 0)


def request_tokens(chunks: DataFrame, request_keys: list[str], carry: list[str] = []) -> DataFrame:
    """Per request: first-token latency, total latency (both seconds), output tokens, TPOT.

    Needs ``request_start`` and ``chunk_ts``. Time per output token is the time after the
    first token over the remaining tokens; null for a single token.
    """
    base = F.unix_micros(F.min("request_start"))
    first, last = F.unix_micros(F.min("chunk_ts")), F.unix_micros(F.max("chunk_ts"))
    folded = non_empty_chunks(chunks).groupBy(*request_keys, *carry).agg(
        ((first - base) / 1e6).alias("ttft_s"),
        ((last - base) / 1e6).alias("latency_s"),
        F.count(F.lit(1)).alias("output_tokens"),
        ((last - first) / 1e6).alias("_tail_s"),
    )
    return folded.withColumn(
        "tpot_s", F.when(F.col("output_tokens") > 1, F.col("_tail_s") / (F.col("output_tokens") - 1))
    ).drop("_tail_s")


def token_latency_metrics(requests: DataFrame, run_keys: list[str], approx: bool = False) -> DataFrame:
    """First-token latency and TPOT statistics per run, in nanoseconds.

    ``requests`` is the output of :func:`request_tokens` with the run keys carried along.
    """
    values = {"first_token_latency_ns": F.col("ttft_s") * NS, "tpot_ns": F.col("tpot_s") * NS}
    plain = requests.groupBy(*run_keys).agg(
        F.count(F.lit(1)).alias("requests"),
        *[
            f(c).alias(f"{stat}_{name}")
            for name, c in values.items()
            for stat, f in [("min", F.min), ("max", F.max), ("mean", F.avg)]
        ],
    )
    percentiles = approx_percentiles if approx else exact_percentiles
    return plain.join(percentiles(requests, run_keys, values, TOKEN_PROBS), run_keys, "left")


def _stretched_gaps(chunks: DataFrame, request_keys: list[str], order: str, most: int) -> DataFrame:
    us = F.unix_micros("chunk_ts")
    rows = equal_cuts(non_empty_chunks(chunks), request_keys, us, "_bucket", most)
    buckets = rows.groupBy(*request_keys, "_bucket").agg(F.max(us).alias("_last"))
    per_request = Window.partitionBy(*request_keys).orderBy("_bucket")
    before = buckets.select(*request_keys, "_bucket", F.lag("_last").over(per_request).alias("_carried"))
    in_bucket = Window.partitionBy(*request_keys, "_bucket").orderBy("chunk_ts", order)
    previous = F.coalesce(F.lag(us).over(in_bucket), F.col("_carried"))
    return (
        rows.join(before, [*request_keys, "_bucket"])
        .withColumn("_prev", previous)
        .withColumn("gap_s", (us - F.col("_prev")) / 1e6)
        .withColumn("ttft_s", F.when(F.col("_prev").isNull(), (us - F.unix_micros("request_start")) / 1e6))
        .drop("_carried", "_prev")
    )


def token_gaps(chunks: DataFrame, request_keys: list[str], order: str = "seq", most: int = MOST_VALUES) -> DataFrame:
    """One row per non-empty chunk with the seconds since the previous one.

    The first chunk of a request has a null gap and carries ``ttft_s``. A request of more than ``most`` chunks is cut into
    stretches of about equal numbers of chunks: gaps inside a stretch come from a window over it, the gap across a
    border from the last time of the previous one, so a huge request is many tasks, however short it was.
    """
    return _stretched_gaps(chunks, request_keys, order, most).drop("_bucket")


def inter_token_latency(chunks: DataFrame, request_keys: list[str], order: str = "seq", most: int = MOST_VALUES) -> DataFrame:
    """Whole request records: TTFT, gap list, token count and text in order.

    One output row holds one answer, whose length the token limit of a request bounds. The
    fold runs per stretch first, so most of the sorting happens on the pieces.
    """
    gaps = _stretched_gaps(chunks, request_keys, order, most)
    pieces = (
        gaps.groupBy(*request_keys, "_bucket")
        .agg(
            F.max("ttft_s").alias("ttft_s"),
            F.sort_array(F.collect_list(F.struct("chunk_ts", order, "gap_s", "text"))).alias("_items"),
        )
        .select(
            *request_keys,
            "_bucket",
            "ttft_s",
            F.array_compact(F.transform("_items", lambda x: x["gap_s"])).alias("_gaps"),
            F.concat_ws("", F.transform("_items", lambda x: x["text"])).alias("_text"),
            F.size("_items").alias("_n"),
        )
    )
    return (
        pieces.groupBy(*request_keys)
        .agg(
            F.max("ttft_s").alias("ttft_s"),
            F.sum("_n").alias("output_tokens"),
            F.sort_array(F.collect_list(F.struct("_bucket", "_gaps", "_text"))).alias("_parts"),
        )
        .select(
            *request_keys,
            "ttft_s",
            "output_tokens",
            F.flatten(F.transform("_parts", lambda p: p["_gaps"])).alias("itl"),
            F.concat_ws("", F.transform("_parts", lambda p: p["_text"])).alias("generated_text"),
        )
    )


def progress_marks(
    df: DataFrame, run_keys: list[str] = ["run_id"], end: str = "end_us", tie: str = "event_id", most: int = MOST_VALUES
) -> DataFrame:
    """Completed counts at the first and at each tenth of a run, in order of end time.

    ``end`` is the end time in microseconds. A run of more than ``most`` rows is cut into stretches of about equal row
    counts, and only those that hold a mark are ranked row by row.
    """
    step = F.greatest(F.lit(1), F.floor(F.col("total") / 10))

    def holds_mark() -> Column:
        return (F.col("before") == 0) | (F.floor(F.col("upto") / step) > F.floor(F.col("before") / step))

    ranked = group_rank(
        equal_cuts(df.select(*run_keys, end, tie), run_keys, F.col(end), "_cut", most),
        run_keys,
        F.col("_cut"),
        [F.col(end), F.col(tie)],
        holds_mark,
        out="completed",
    )
    return ranked.where((F.col("completed") == 1) | (F.col("completed") % step == 0)).select(
        *run_keys, "completed", "total", end, tie, (F.col("completed") / F.col("total") * 100).alias("percent")
    )


def sweep_plan(max_df: DataFrame, points: int = 10, budget: float = 1.2, initial: float = 1000.0) -> DataFrame:
    """Target rates of a sweep: ``points`` equal steps up to ``budget`` times the maximum.

    ``max_df`` has ``max_throughput``; a null or non-positive maximum counts as half of the
    initial rate.
    """
    top = F.when(F.col("max_throughput") > 0, F.col("max_throughput")).otherwise(F.lit(initial / 2))
    return (
        max_df.withColumn("max_throughput", top)
        .withColumn("point", F.explode(F.sequence(F.lit(1), F.lit(points))))
        .withColumn(
            "target_qps",
            F.bround(F.col("point") * (F.col("max_throughput") * F.lit(float(budget))) / points, 2),
        )
    )


def sweep_curve(sweeps: DataFrame, sweep_keys: list[str] = ["sweep_id"]) -> DataFrame:
    """Sweep points with an error flag and the share of the best achieved rate."""
    wanted = [
        "target_qps", "samples_per_second", "tokens_per_second",
        "mean_latency_ns", "p50_latency_ns", "p90_latency_ns", "p99_latency_ns",
    ]
    peak = sweeps.groupBy(*sweep_keys).agg(F.max("samples_per_second").alias("_peak"))
    return (
        sweeps.join(peak, sweep_keys)
        .select(
            *sweep_keys,
            *[c for c in wanted if c in sweeps.columns],
            F.col("error").isNotNull().alias("failed"),
            F.try_divide(F.col("samples_per_second"), F.col("_peak")).alias("fraction_of_max"),
        )
        .orderBy(*sweep_keys, "target_qps")
    )
