"""Dashboard tables: key figures, best systems, cost views, pair comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hardware import accuracy_entries, percent_of
from ..schema import qcol
from .enrich import tokens_per_accelerator

TOKENS = "result.tokens_per_second"
PRICE = "system.price_per_hour"
COST = "result.cost_per_million_tokens"
UID = "submission.debug_uid"


def kpis(df: DataFrame, approx: bool = False) -> DataFrame:
    """Distinct systems, submitters, accelerators (a null counts as a value), rows, accelerators."""

    def distinct(name: str) -> Column:
        count = F.approx_count_distinct if approx else F.count_distinct
        return count(qcol(name)) + F.coalesce(F.max(qcol(name).isNull().cast("long")), F.lit(0))

    return df.agg(
        distinct("system.name").alias("systems"),
        distinct("submission.organization").alias("submitters"),
        distinct("system.accelerator.name").alias("accelerators"),
        F.count(F.lit(1)).alias("results"),
        F.coalesce(F.sum(qcol("system.total_accelerators")), F.lit(0)).alias("total_accelerators"),
    )


def value_counts(df: DataFrame, col: str) -> DataFrame:
    """Rows per value, most frequent first; null is a value."""
    return (
        df.groupBy(qcol(col).alias(col))
        .agg(F.count(F.lit(1)).alias("count"))
        .orderBy(F.desc("count"), qcol(col))
    )


def distinct_sorted(df: DataFrame, col: str, drop_nulls: bool = True) -> DataFrame:
    values = df.select(qcol(col)).distinct()
    return (values.where(qcol(col).isNotNull()) if drop_nulls else values).orderBy(qcol(col))


def overview(df: DataFrame) -> DataFrame:
    names = [
        "benchmark.name", "benchmark.version", "model.name", "system.name",
        "system.accelerator.name", "system.total_accelerators", TOKENS, "metrics.accuracy",
    ]
    return df.select(*[qcol(n) for n in names])


def best_per_group(
    df: DataFrame, keys: list[str], metric: str = TOKENS, tiebreak: list[str] = [UID], cols: list[str] | None = None
) -> DataFrame:
    """The row with the largest metric per group; nulls lose, ties go to the largest key.

    An aggregation with map-side combine: at most one row per group leaves each task, so a
    group with a third of all rows costs no more network than any other.
    """
    wanted = cols or df.columns
    row = F.struct(*[qcol(c).alias(c) for c in wanted])
    rank = F.struct(*[qcol(c) for c in [metric, *tiebreak]])
    best = df.groupBy(*[qcol(k).alias(k) for k in keys]).agg(F.max_by(row, rank).alias("_best"))
    return best.select(*[F.col("_best").getField(c).alias(c) for c in wanted])


def rank_systems(
    df: DataFrame, keys: list[str], metric: str = TOKENS, n: int = 1, tiebreak: list[str] = [UID]
) -> DataFrame:
    """Top ``n`` rows per group with their ``rank``; Spark trims groups before the shuffle."""
    order = [qcol(metric).desc_nulls_last(), *[qcol(c).desc_nulls_last() for c in tiebreak]]
    place = F.row_number().over(Window.partitionBy(*[qcol(k) for k in keys]).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= n)


def pivot_first(
    df: DataFrame, key: list[str], name: str, value: str, pos: str,
    names: list[str] | None = None, prefix: str = "", out: str = "values",
) -> DataFrame:
    """The value of lowest position per (key, name): a column per wanted name, or without ``names`` a map column ``out`` of
    all names that the key has. Null names count for nothing."""
    named = df.where(F.col(name).isNotNull())
    if names is None:
        first = named.groupBy(*key, name).agg(F.min_by(value, pos).alias("_first"))
        entries = F.array_sort(F.collect_list(F.struct(F.col(name), F.col("_first"))))
        return first.groupBy(*key).agg(F.map_from_entries(entries).alias(out))
    wide = df.groupBy(*key).pivot(name, names).agg(F.min_by(value, pos))
    return wide.select(*key, *[qcol(n).alias(prefix + n) for n in names])


def accuracy_keys(df: DataFrame, col: str = "metrics.accuracy") -> DataFrame:
    """Accuracy metric names that occur in the table."""
    return df.select(F.explode(accuracy_entries(qcol(col))).alias("e")).select(F.col("e.key").alias("key")).distinct()


VIEW_COLUMNS = [
    "model.name", "submission.scenario", "system.name", "system.accelerator.name",
    "system.total_accelerators", TOKENS, PRICE, COST, UID,
]


def _board(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    return best_per_group(df.select(*[qcol(c) for c in cols]), keys)


PERFORMANCE_KEYS = ["model.name", "submission.scenario", "system.name"]
COST_KEYS = ["model.name", "system.name"]


def performance_view(df: DataFrame) -> DataFrame:
    """Best row per (model, scenario, system), with tokens/s per accelerator."""
    return tokens_per_accelerator(_board(df, PERFORMANCE_KEYS, VIEW_COLUMNS))


def cost_view(df: DataFrame) -> DataFrame:
    """Best row per (model, system) with price and cost."""
    return _board(df, COST_KEYS, [*VIEW_COLUMNS, "usd_per_million_tokens"])


def cost_vs_performance_view(df: DataFrame) -> DataFrame:
    """Price against tokens/s of the best row per (model, system)."""
    best = _board(df, COST_KEYS, VIEW_COLUMNS)
    return best.select(*[qcol(c) for c in ["model.name", "system.name", "system.accelerator.name", "system.total_accelerators", PRICE, TOKENS, COST]])


# --- pairs ------------------------------------------------------------------------

CONFIG_KEYS = ["model.name", "system.accelerator.name", "system.total_accelerators"]


def best_per_configuration(df: DataFrame) -> DataFrame:
    """Best row per (model, accelerator, total count), the unit of pair comparison."""
    cols = [*CONFIG_KEYS, "system.name", "submission.organization", TOKENS, PRICE, UID]
    return best_per_group(df.select(*[qcol(c) for c in cols]), CONFIG_KEYS).where(
        qcol("system.accelerator.name").isNotNull()
    )


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(
        qcol("model.name").alias(f"model_{side}"),
        qcol("system.accelerator.name").alias(f"accelerator_{side}"),
        qcol("system.total_accelerators").alias(f"count_{side}"),
        qcol("system.name").alias(f"system_{side}"),
        qcol(TOKENS).alias(f"tokens_per_second_{side}"),
        qcol(PRICE).alias(f"price_per_hour_{side}"),
        qcol(UID).alias(f"uid_{side}"),
    )


def compare_systems(best: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Reference system A against comparison system B, one row per pair of one model.

    ``pairs`` names them: (model, accelerator_a, count_a, accelerator_b, count_b). Without
    it every configuration is compared with the fastest one of its model that has a price,
    which keeps the result linear in the number of configurations. Equality joins only.
    """
    b = _side(best, "b")
    if pairs is None:
        priced = best.where(qcol(PRICE).isNotNull())
        a = _side(best_per_group(priced, ["model.name"]), "a")
        joined = b.join(a, F.col("model_a") == F.col("model_b")).where(F.col("uid_a") != F.col("uid_b"))
    else:
        a = _side(best, "a")
        p = pairs.select(*[F.col(c).alias(f"_{c}") for c in ["model", "accelerator_a", "count_a", "accelerator_b", "count_b"]])

        def same(side: str) -> Column:
            return (
                (F.col("_model") == F.col(f"model_{side}"))
                & (F.col(f"_accelerator_{side}") == F.col(f"accelerator_{side}"))
                & (F.col(f"_count_{side}") == F.col(f"count_{side}"))
            )

        joined = p.join(a, same("a")).join(b, same("b")).where(F.col("uid_a") != F.col("uid_b")).drop(*p.columns)
    return pair_deltas(joined.withColumnRenamed("model_a", "model").drop("model_b"))


def pair_deltas(pairs: DataFrame) -> DataFrame:
    """Throughput and cost differences of B against A; cost is price/h x tokens/s / 60."""
    perf_a, perf_b = F.col("tokens_per_second_a"), F.col("tokens_per_second_b")
    with_cost = pairs.withColumns(
        {
            "cost_a": perf_a * F.col("price_per_hour_a") / 60,
            "cost_b": perf_b * F.col("price_per_hour_b") / 60,
            "perf_delta": perf_b - perf_a,
            "price_delta": F.col("price_per_hour_b") - F.col("price_per_hour_a"),
        }
    )
    delta = F.col("cost_b") - F.col("cost_a")
    return with_cost.withColumns(
        {
            "perf_delta_pct": percent_of(F.col("perf_delta"), perf_a),
            "cost_delta": delta,
            "cost_delta_pct": percent_of(delta, F.col("cost_a")),
        }
    )


def cost_sensitivity(pairs: DataFrame, points: int = 100, factor: float = 1.25) -> DataFrame:
    """Price x throughput grid around each pair, ``points`` steps per axis from zero.

    Each pair expands into its own grid inside its task; nothing is joined or shuffled. The
    percents are relative to the reference *price* (``cost_delta_pct_of_price``, the grid
    figure) and to the reference *cost* (``cost_delta_pct_of_cost``, the point figure).
    """

    def axis(i: str, top: str) -> Column:
        last = F.lit(points - 1)
        return F.when(F.col(i) == last, F.col(top)).otherwise(F.col(i) * (F.col(top) / last))

    steps = F.sequence(F.lit(0), F.lit(points - 1))
    ref_price, ref_perf = F.col("price_per_hour_a"), F.col("tokens_per_second_a")
    ref_cost = ref_price * ref_perf / 60
    corner = (F.col("_max_x") * F.col("_max_y") - ref_price * ref_perf) / 60
    grid = (
        pairs.where(F.col("price_per_hour_a").isNotNull() & F.col("price_per_hour_b").isNotNull())
        .withColumns(
            {
                "_max_x": F.greatest("price_per_hour_a", "price_per_hour_b") * factor,
                "_max_y": F.greatest("tokens_per_second_a", "tokens_per_second_b") * factor,
            }
        )
        .withColumn("max_abs_cost_delta", F.greatest(F.abs(corner), F.abs(ref_cost)))
        .withColumn("ix", F.explode(steps))
        .withColumn("iy", F.explode(steps))
        .withColumns({"price_per_hour": axis("ix", "_max_x"), "tokens_per_second": axis("iy", "_max_y")})
    )
    price, perf = F.col("price_per_hour"), F.col("tokens_per_second")
    delta = (price * perf - ref_price * ref_perf) / 60
    units = F.when(F.coalesce(F.col("count_b"), F.lit(0)) == 0, F.lit(1)).otherwise(F.col("count_b"))
    return grid.select(
        "model", "uid_a", "uid_b", "ix", "iy", "price_per_hour", "tokens_per_second",
        (price / units).alias("unit_price_per_hour"),
        (perf - ref_perf).alias("perf_delta"),
        percent_of(perf - ref_perf, ref_perf).alias("perf_delta_pct"),
        (price * perf / 60).alias("cost"),
        delta.alias("cost_delta"),
        percent_of(delta, ref_price).alias("cost_delta_pct_of_price"),
        percent_of(delta, ref_cost).alias("cost_delta_pct_of_cost"),
        "max_abs_cost_delta",
    )
