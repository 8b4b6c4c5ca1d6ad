"""Similarity of configurations: queries against a table, and neighbour counts for all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.hardware import within_tolerance
from ..schema import qcol
from .ranks import MOST_VALUES, equal_cuts, running_offsets, settled


def _log_band(v: Column, tol: float) -> Column:
    """Band number such that values within ``tol`` of each other are at most one band apart."""
    width = F.lit(-1.0) * F.log(F.lit(1 - tol))
    number = F.floor(F.log(F.abs(v)) / width)
    return (
        F.when(v.isNull(), F.lit("null"))
        .when(v == 0, F.lit("zero"))
        .otherwise(F.concat(F.when(v < 0, F.lit("-")).otherwise(F.lit("+")), number.cast("string")))
    )


def _bands_around(v: Column, tol: float) -> Column:
    width = F.lit(-1.0) * F.log(F.lit(1 - tol))
    number = F.floor(F.log(F.abs(v)) / width)
    sign = F.when(v < 0, F.lit("-")).otherwise(F.lit("+"))
    near = F.array(*[F.concat(sign, (number + d).cast("string")) for d in (-1, 0, 1)])
    return F.when(v.isNull() | (v == 0), F.array(_log_band(v, tol))).otherwise(near)


def similar_to(
    df: DataFrame, queries: DataFrame, categorical: list[str], continuous: str, query_id: str = "query_id", tol: float = 0.1
) -> DataFrame:
    """Rows of ``df`` close to each query configuration.

    Equality on the categorical features, :func:`within_tolerance` on the continuous one. The
    band number turns the range condition into an equality join; each query is looked up in
    its own band and both neighbours, so every close row is found and none twice.
    """
    left = df.withColumn("_band", _log_band(qcol(continuous), tol))
    wanted = queries.select(
        F.col(query_id),
        *[qcol(c).alias(f"_q_{i}") for i, c in enumerate(categorical)],
        qcol(continuous).alias("_q_v"),
        F.explode(_bands_around(qcol(continuous), tol)).alias("_q_band"),
    )
    cond = F.col("_band") == F.col("_q_band")
    for i, c in enumerate(categorical):
        cond = cond & (qcol(c) == F.col(f"_q_{i}"))
    return left.join(wanted, cond & within_tolerance(qcol(continuous), F.col("_q_v"), tol)).select(
        query_id, *[qcol(c) for c in df.columns]
    )


def similar_counts(
    df: DataFrame, categorical: list[str], continuous: str, tol: float = 0.1, most: int = MOST_VALUES
) -> DataFrame:
    """For every distinct configuration, how many rows lie in its band ``v(1-t) .. v(1+t)``.

    All-pairs similarity without building a pair: equal configurations are merged, then each
    one asks for the number of rows below its lower and up to its upper edge. The questions are
    sorted in among the values, and running totals answer them. A block of up to ``most`` values is brought
    to one task before its questions are made, and is answered there; only larger blocks are cut into
    stretches of about equal counts, whose answers are then brought together. Work is linear in the number
    of configurations plus sorting, whatever the size of the largest block. Null and
    negative values have an empty band (its edges cross) and count 0.
    """
    keys = [f"_k{i}" for i in range(len(categorical))]
    configs = df.groupBy(
        *[qcol(c).alias(k) for c, k in zip(categorical, keys)], qcol(continuous).cast("double").alias("v")
    ).agg(F.count(F.lit(1)).alias("rows"))
    configs = settled(configs, "configurations")
    blocks = keys or ["_all"]
    configs = configs if keys else configs.withColumn("_all", F.lit(0))
    v = F.col("v")
    # Equality of a criterion never matches null, so such configurations have no neighbours.
    usable = v.isNotNull() & (v >= 0)
    for k in keys:
        usable = usable & F.col(k).isNotNull()
    usable = F.coalesce(usable, F.lit(False))
    alone = configs.where(~usable).withColumn("similar_rows", F.lit(0).cast("long"))
    asking = configs.where(usable)
    # At most one block in every ``most`` configurations is large, so the list of them is short.
    large = settled(asking.groupBy(*blocks).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most).select(*blocks), "large-blocks")
    cut = bool(large.limit(1).count())
    small = asking.join(F.broadcast(large), blocks, "left_anti") if cut else asking
    whole = _marks(small.repartition(*blocks), blocks, tol)
    found = [alone, _bands(whole.withColumn("upto", F.sum("n").over(_so_far(blocks))), blocks)]
    if cut:
        points = _marks(asking.join(F.broadcast(large), blocks, "left_semi"), blocks, tol).transform(equal_cuts, blocks, F.col("x"), "bin", most)
        bins = running_offsets(points.groupBy(*blocks, "bin").agg(F.sum("n").alias("n")), blocks, "bin")
        answered = points.join(bins.select(*blocks, "bin", "before"), [*blocks, "bin"])
        found.append(_bands(answered.withColumn("upto", F.col("before") + F.sum("n").over(_so_far([*blocks, "bin"]))), blocks))
    return reduce(DataFrame.unionByName, found).select(
        *[F.col(k).alias(c) for c, k in zip(categorical, keys)], v.alias(continuous), "rows", "similar_rows"
    )


def _marks(configs: DataFrame, keys: list[str], tol: float) -> DataFrame:
    """Three rows of a configuration: its lower edge, its value with its rows, its upper edge."""
    v, none = F.col("v"), F.lit(0).cast("long")
    # kind orders equal positions: a lower edge before the values, an upper edge after them.
    marks = [
        F.struct(x.alias("x"), F.lit(kind).alias("kind"), n.alias("n"))
        for kind, x, n in [(0, v * (1 - tol), none), (1, v, F.col("rows")), (2, v * (1 + tol), none)]
    ]
    return configs.select(*keys, "v", "rows", F.inline(F.array(*marks)))


def _so_far(block: list[str]) -> WindowSpec:
    return Window.partitionBy(*block).orderBy("x", "kind").rowsBetween(Window.unboundedPreceding, 0)


def _bands(answered: DataFrame, keys: list[str]) -> DataFrame:
    """Rows up to the upper edge less the rows below the lower one, per configuration."""
    upto, kind = F.col("upto"), F.col("kind")
    near = F.max(F.when(kind == 2, upto)) - F.max(F.when(kind == 0, upto))
    return answered.where(kind != 1).groupBy(*keys, "v").agg(F.first("rows").alias("rows"), near.alias("similar_rows"))
