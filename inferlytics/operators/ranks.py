"""Exact ranks and percentiles that never put a whole group into one task.

A group (a run, a request) may hold a third of all rows. A plain window over the group
would sort it in one task, and an exact percentile aggregate would keep all its values in
one buffer. Here a cheap histogram over value ranges comes first: it is counted before the
shuffle and has few rows per group. Running totals over the histogram say how many rows
precede each range, and only the ranges that hold a wanted rank are looked at row by row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..streaming.storage import shared_folder

#: Rows of a group that are ranked value by value without cutting.
MOST_VALUES = 100_000
#: Size of a sketch, share of rows on either side of a wanted rank, and cuts of a range that is still too full.
SKETCH, MARGIN, CUTS = 1000, 0.01, 128
#: Stretches of a large group; a power of two.
STRETCHES = 1024

#: Ranges per e-fold of a value; neighbouring ranges differ by about 1.5 %.
RESOLUTION = 64


def value_range(v: Column, resolution: int = RESOLUTION) -> Column:
    """Order-preserving range number of a double, on a logarithmic scale around zero."""
    return (F.signum(v) * F.floor(F.log(F.abs(v) + 1) * resolution)).cast("long")


def running_offsets(counts: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Add rows before (``before``), rows so far (``upto``) and ``total`` per group."""
    if not keys:
        counts = counts.withColumn("_all", F.lit(0))
    group = Window.partitionBy(*(keys or ["_all"]))
    upto = F.sum("n").over(group.orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    out = counts.select(
        "*", (upto - F.col("n")).alias("before"), upto.alias("upto"), F.sum("n").over(group).alias("total")
    )
    return out if keys else out.drop("_all")


def _join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equality join that also matches null keys."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in keys]
    return left.join(renamed, cond, how).drop(*[f"_r_{k}" for k in keys])


def settled(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: sketches differ from run to run, their readers must not."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def equal_cuts(df: DataFrame, keys: list[str], value: Column, out: str, most: int = MOST_VALUES) -> DataFrame:
    """Add the number of the stretch of values that a row lies in, growing with ``value`` inside a group.

    Groups of up to ``most`` rows are one stretch, 0. Larger ones are cut at the quantiles of a sketch into ``STRETCHES``
    stretches of about equal row counts, so a short and a long group of as many rows are as many tasks. Equal values share
    a stretch, nulls are in stretch 0. The borders are written once, so every reader sees the same.
    """
    plain = keys or ["_all"]
    rows = df if keys else df.withColumn("_all", F.lit(0))
    large = settled(rows.groupBy(*plain).agg(F.count(value).alias("_rows")).where(F.col("_rows") > most).select(*plain), "large-groups")
    if not large.limit(1).count():
        return df.withColumn(out, F.lit(0))
    sketch = F.kll_sketch_agg_double(value.cast("double"), F.lit(SKETCH))
    cuts = F.kll_sketch_get_quantile_double("_sketch", F.array(*[F.lit(k / STRETCHES) for k in range(1, STRETCHES)]))
    borders = _join_on(rows, large, plain).groupBy(*plain).agg(sketch.alias("_sketch")).select(*plain, cuts.alias("_borders"))
    joined = _join_on(rows, settled(borders, "borders"), plain, "left")
    steps = F.array(*[F.lit(STRETCHES >> k) for k in range(1, STRETCHES.bit_length())])

    def search(at: Column, step: Column) -> Column:
        return F.when(F.get("_borders", at + step - 1) <= value, at + step).otherwise(at)

    number = F.when(F.col("_borders").isNotNull(), F.aggregate(steps, F.lit(0), search)).otherwise(F.lit(0))
    return joined.withColumn(out, number).drop("_borders", *([] if keys else ["_all"]))


def exact_percentiles(
    df: DataFrame,
    keys: list[str],
    values: dict[str, Column],
    probs: dict[str, float],
    most: int = MOST_VALUES,
) -> DataFrame:
    """Percentiles with linear interpolation, one row per group.

    ``values`` maps a metric name to a column and ``probs`` a statistic name to a fraction;
    the result has columns ``<stat>_<metric>``. Null and NaN values are ignored.

    The whole range of a group is ranked value by value when it has up to ``most`` rows. In a larger group each wanted
    rank gets a range of its own, cut at quantiles of a mergeable sketch of the group; the rows below and inside are
    counted, which proves the range or names the side on which the rank lies, and a range that is still too full is cut
    again. Each round is one scan for all metrics, and shares of rows and not widths of ranges decide, so neither the
    scale of the values nor a crowded spot matters.
    """
    plain = keys or ["_all"]
    rows = df.select(*keys, *[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"_v{i}") for i, c in enumerate(values.values())])
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    wants = [(i, j, p) for i in range(len(values)) for j, p in enumerate(probs.values())]
    state = settled(_whole_ranges(rows, plain, len(values), wants, most), "percentile-ranges")
    fullest = [F.max(f"_in_{i}_{j}") for i, j, _ in wants]
    full = state.agg(F.greatest(*fullest, F.lit(0))).first()[0]
    stuck = 0
    while full > most and stuck < 2:  # stuck: few values, many times each; equal values are merged below
        state = settled(_cut_ranges(rows, state, plain, wants), "percentile-ranges")
        before, full = full, state.agg(F.greatest(*fullest, F.lit(0))).first()[0]
        stuck = stuck + 1 if full > 0.9 * before else 0

    ranges = F.flatten(
        F.array(
            *[
                F.array_distinct(
                    F.array(*[F.struct(F.lit(i).alias("m"), *[F.col(f"_{f}_{i}_{j}").alias(f) for f in ("least", "most", "base")], F.col(f"_n{i}").alias("n"), F.col(f"_v{i}").alias("v"))
                              for k, j, _ in wants if k == i])
                )
                for i in range(len(values))
            ]
        )
    )
    held = F.filter(ranges, lambda r: r["v"].between(r["least"], r["most"]))
    near = _join_on(rows, state, plain).select(*plain, F.explode(held).alias("r")).select(*plain, "r.*")
    of_range = [*plain, "m", "least", "most", "base", "n"]
    ranked = near.groupBy(*of_range, "v").agg(F.count(F.lit(1)).alias("rows"))
    inside = Window.partitionBy(*of_range).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = ranked.withColumn("upto", F.col("base") + F.sum("rows").over(inside)).withColumn("from", F.col("upto") - F.col("rows"))

    def at(rank: Column, i: int) -> Column:
        return F.max(F.when((F.col("m") == i) & (F.col("from") <= rank) & (rank < F.col("upto")), F.col("v")))

    aggs, out = [], []
    for i, metric in enumerate(values):
        for stat, p in probs.items():
            name, pos = f"{stat}_{metric}", F.lit(p) * (F.col("n") - 1)
            aggs += [
                at(F.floor(pos), i).alias(f"_lo_{name}"),
                at(F.ceil(pos), i).alias(f"_hi_{name}"),
                F.max(F.when(F.col("m") == i, pos - F.floor(pos))).alias(f"_f_{name}"),
            ]
            lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
            out.append((lo + (hi - lo) * F.col(f"_f_{name}")).alias(name))
    return ranked.groupBy(*plain).agg(*aggs).select(*keys, *out)


def _whole_ranges(rows: DataFrame, keys: list[str], metrics: int, wants: list[tuple[int, int, float]], most: int) -> DataFrame:
    """Per group and wanted rank: the proven range (least, most, rows below it, rows inside) and a narrower one to try.

    First the whole range is proven; the one to try comes from a sketch, which small groups do not need.
    """
    aggs = []
    for i in range(metrics):
        v = F.col(f"_v{i}")
        aggs += [F.count(v).alias(f"_n{i}"), F.min(v).alias(f"_min{i}"), F.max(v).alias(f"_max{i}"), F.kll_sketch_agg_double(v, F.lit(SKETCH)).alias(f"_q{i}")]
    found = rows.groupBy(*keys).agg(*aggs)
    cols = [F.col(f"_n{i}") for i in range(metrics)]
    for i, j, p in wants:
        n, low, high = F.col(f"_n{i}"), F.col(f"_min{i}"), F.col(f"_max{i}")
        tried = F.when(n > most, F.kll_sketch_get_quantile_double(f"_q{i}", F.array(*[F.lit(min(max(p + side, 0.0), 1.0)) for side in (-MARGIN, MARGIN)])))
        cols += [
            low.alias(f"_least_{i}_{j}"), high.alias(f"_most_{i}_{j}"), F.lit(0).cast("long").alias(f"_base_{i}_{j}"), n.alias(f"_in_{i}_{j}"),
            F.coalesce(tried[0], low).alias(f"_try_{i}_{j}"), F.coalesce(tried[1], high).alias(f"_end_{i}_{j}"),
        ]
    return found.select(*keys, *cols)


def _cut_ranges(rows: DataFrame, state: DataFrame, keys: list[str], wants: list[tuple[int, int, float]]) -> DataFrame:
    """The state after counting every range to try: the part in which the rank lies is proven, and cut by its sketch."""
    aggs = [F.first(c).alias(c) for c in state.columns if c not in keys]
    for i, j, _ in wants:
        v, lo, hi = F.col(f"_v{i}"), F.col(f"_try_{i}_{j}"), F.col(f"_end_{i}_{j}")
        inside = v.between(lo, hi)
        aggs += [
            F.count_if((v >= F.col(f"_least_{i}_{j}")) & (v < lo)).alias(f"_below_{i}_{j}"),
            F.count_if(inside & (v < hi)).alias(f"_under_{i}_{j}"),
            F.count_if(inside).alias(f"_inside_{i}_{j}"),
            F.kll_sketch_agg_double(F.when(inside, v), F.lit(SKETCH)).alias(f"_q_{i}_{j}"),
        ]
    counted = _join_on(rows, state, keys).groupBy(*keys).agg(*aggs)
    cols = [F.col(c) for c in state.columns if c.startswith("_n")]
    for i, j, p in wants:
        g = {f: F.col(f"_{f}_{i}_{j}") for f in ("least", "most", "base", "in", "try", "end", "below", "under", "inside", "q")}
        pos = F.lit(p) * (F.col(f"_n{i}") - 1)
        first = g["base"] + g["below"]
        early, late = F.floor(pos) < first, F.ceil(pos) >= first + g["inside"]
        hit = ~early & ~late
        least = F.when(hit, g["try"]).when(late & ~early, g["end"]).otherwise(g["least"])
        highest = F.when(hit, g["end"]).when(early & ~late, g["try"]).otherwise(g["most"])
        base = F.when(hit, first).when(late & ~early, first + g["under"]).otherwise(g["base"])
        # Rows inside are exact for a hit; else at most those of the range before.
        size = F.when(hit, g["inside"]).otherwise(g["in"])
        borders = F.when(g["inside"] > 0, F.kll_sketch_get_quantile_double(g["q"], F.array(*[F.lit(k / CUTS) for k in range(CUTS + 1)])))
        share = F.floor((pos - first) * CUTS / g["inside"])
        lower = F.get(borders, F.greatest(share - 1, F.lit(0)).cast("int"))
        upper = F.get(borders, F.least(share + 2, F.lit(CUTS)).cast("int"))
        cols += [
            least.alias(f"_least_{i}_{j}"), highest.alias(f"_most_{i}_{j}"), base.alias(f"_base_{i}_{j}"), size.alias(f"_in_{i}_{j}"),
            F.when(hit, lower).otherwise(least).alias(f"_try_{i}_{j}"), F.when(hit, upper).otherwise(highest).alias(f"_end_{i}_{j}"),
        ]
    return counted.select(*keys, *cols)


def approx_percentiles(
    df: DataFrame, keys: list[str], values: dict[str, Column], probs: dict[str, float], accuracy: int = 10000
) -> DataFrame:
    """One-pass sketch percentiles with the columns of :func:`exact_percentiles`."""
    return df.groupBy(*keys).agg(
        *[
            F.percentile_approx(c.cast("double"), p, accuracy).alias(f"{stat}_{metric}")
            for metric, c in values.items()
            for stat, p in probs.items()
        ]
    )


def group_rank(
    df: DataFrame,
    keys: list[str],
    bin_col: Column,
    order: list,
    keep_bins: Callable[[], Column] | None = None,
    out: str = "rank",
) -> DataFrame:
    """Row number (from 1) and group size, by ``order`` within ``keys``.

    ``bin_col`` must not decrease along ``order``; it is what splits a group into tasks.
    ``keep_bins`` may drop bins that hold no wanted rank, using ``before``, ``upto`` and
    ``total``, before any row is shuffled.
    """
    rows = df.withColumn("_bin", bin_col)
    bins = running_offsets(rows.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("n")), keys, "_bin")
    if keep_bins is not None:
        bins = bins.where(keep_bins())
    joined = _join_on(rows, bins.select(*keys, "_bin", "before", "total"), [*keys, "_bin"])
    within = Window.partitionBy(*keys, "_bin").orderBy(*order)
    return joined.withColumn(out, F.col("before") + F.row_number().over(within)).drop("_bin", "before")


def ordered_index(df: DataFrame, major: str, minor: str, out: str = "sample_idx", most: int = MOST_VALUES) -> DataFrame:
    """Position from 0 by two numeric columns, over the whole table.

    The table is cut into stretches of majors with about equal row counts, whatever ids there are, and a major with very
    many rows into stretches of minors. Rows are counted per major and stretch, the counts are added up inside the
    stretches of majors and then over these (``STRETCHES`` at most), so no task sees the whole table.
    """
    rows = equal_cuts(df, [], F.col(major), "_jb", most).transform(equal_cuts, [major], F.col(minor), "_mb", most)
    cells = rows.groupBy("_jb", major, "_mb").agg(F.count(F.lit(1)).alias("n"))
    blocks = running_offsets(cells.groupBy("_jb").agg(F.sum("n").alias("n")), [], "_jb").select(
        F.col("_jb").alias("_b"), F.col("before").alias("_block_base")
    )
    in_block = Window.partitionBy("_jb").orderBy(major, "_mb").rowsBetween(Window.unboundedPreceding, 0)
    base = (
        cells.withColumn("_cell_base", F.sum("n").over(in_block) - F.col("n"))
        .join(blocks, F.col("_jb") == F.col("_b"))
        .select(F.col(major).alias("_j"), F.col("_mb").alias("_m"), (F.col("_cell_base") + F.col("_block_base")).alias("_base"))
    )
    cell = Window.partitionBy(major, "_mb").orderBy(minor)
    return (
        rows.join(base, (F.col(major) == F.col("_j")) & (F.col("_mb") == F.col("_m")))
        .withColumn(out, F.col("_base") + F.row_number().over(cell) - 1)
        .drop("_jb", "_mb", "_j", "_m", "_base")
    )
