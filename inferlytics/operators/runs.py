"""Run documents: merging performance and accuracy halves, unions, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .clean import drop_null_fields


def _filled_map(first: Column, late: Column) -> Column:
    gaps = F.map_filter(late, lambda k, v: ~F.map_contains_key(first, k))
    return F.coalesce(F.map_concat(first, gaps), first, late)


def merge_runs(
    perf: DataFrame,
    acc: DataFrame,
    acc_results: DataFrame | None = None,
    listing: DataFrame | None = None,
    key: str = "run_id",
) -> DataFrame:
    """One row per run: performance values win, accuracy values fill the gaps.

    Maps are merged key by key. ``acc_results`` (key and any columns) is nested as ``accuracy_results``. ``listing`` (key,
    optionally ``datetime`` from the directory name) adds runs that left no file. Runs are
    unique per table; the outer joins are on the run id alone.
    """
    fields = [c for c in dict.fromkeys([*perf.columns, *acc.columns]) if c != key]
    # A column only one half has is a null in the other.
    halves = []
    for side, df in (("_p", perf), ("_a", acc)):
        types = dict((perf if side == "_a" else acc).dtypes)
        cols = [F.col(c) if c in df.columns else F.lit(None).cast(types[c]).alias(c) for c in fields]
        halves.append(df.select(key, F.struct(*cols).alias(side)))
    merged = halves[0].join(halves[1], key, "full_outer")
    if acc_results is not None:
        nested = acc_results.select(key, F.struct(*[c for c in acc_results.columns if c != key]).alias("accuracy_results"))
        merged = merged.join(nested, key, "full_outer")
    else:
        merged = merged.withColumn("accuracy_results", F.lit(None).cast("struct<rouge1:double>"))
    dated = listing is not None and "datetime" in listing.columns
    if listing is not None:
        extra = [F.col("datetime").alias("_dir_datetime")] if dated else []
        merged = merged.join(listing.select(key, *extra), key, "full_outer")

    has_perf = F.col("_p").isNotNull()
    has_acc = F.col("_a").isNotNull() | F.col("accuracy_results").isNotNull()
    values = drop_null_fields(F.col("_p"), fields, F.col("_a"))
    kinds = dict(perf.dtypes)
    for name in set(perf.columns) & set(acc.columns) & set(fields):
        if kinds[name].startswith("map<"):
            values[name] = _filled_map(F.col("_p")[name], F.col("_a")[name])
    mode = values.pop("mode", F.lit(None).cast("string"))
    if dated:
        # A time in a performance file replaces that of the directory; others only fill in.
        stamp = [F.col("_p")["datetime"]] if "datetime" in fields else []
        late = [F.col("_a")["datetime"]] if "datetime" in fields else []
        values["datetime"] = F.coalesce(*stamp, F.col("_dir_datetime"), *late)
    return merged.select(
        key,
        *[c.alias(n) for n, c in values.items()],
        F.when(has_perf & has_acc, F.lit("PerformanceAndAccuracy"))
        .when(has_perf, F.coalesce(mode, F.lit("PerformanceOnly")))
        .when(has_acc, F.coalesce(mode, F.lit("AccuracyOnly")))
        .alias("mode"),
        "accuracy_results",
    )


def combine(published: DataFrame, local: DataFrame) -> DataFrame:
    """Bag union of the published table and local runs; columns may differ."""
    return published.withColumn("source", F.lit("published")).unionByName(
        local.withColumn("source", F.lit("local")), allowMissingColumns=True
    )


def order_runs(df: DataFrame, key: str = "run_dir") -> DataFrame:
    return df.orderBy(key)


def run_summary(df: DataFrame) -> DataFrame:
    """Total runs, runs with a throughput, runs with accuracy results."""
    return df.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.count_if(F.col("samples_per_second").isNotNull()).alias("performance_runs"),
        F.count_if(F.col("accuracy_results").isNotNull()).alias("accuracy_runs"),
    )
