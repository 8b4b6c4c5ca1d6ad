"""Cleaning of raw result tables: aliases, placeholder text, units, types, quality."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import hardware as hw
from ..schema import (
    ALIASES,
    INTEGER_COLUMNS,
    INTERCONNECT_COLUMNS,
    MEMORY_COLUMNS,
    conform,
    qcol,
)

ACCELERATOR = "system.accelerator.name"
UNPRICED = "unpriced_accelerators"


def replace_columns(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    """One projection that swaps the named columns and keeps the column order."""
    return df.select(*[new[c].alias(c) if c in new else qcol(c) for c in df.columns])


def resolve_aliases(
    df: DataFrame,
    aliases: list[tuple[str, str]] = ALIASES,
    mode: str = "last_column_wins",
) -> DataFrame:
    """Rename raw keys to canonical columns and drop everything else.

    ``last_column_wins`` takes the last present alias as a whole, nulls included.
    ``coalesce`` falls back row by row to the earlier aliases.
    """
    present = set(df.columns)
    sources: dict[str, list[str]] = {}
    for raw, target in aliases:
        found = sources.setdefault(target, [target] if target in present else [])
        if raw in present:
            found[:] = [raw, *[s for s in found if s != raw]]
    out = []
    for target, names in sources.items():
        if not names:
            continue
        if mode == "coalesce" and len(names) > 1:
            out.append(F.coalesce(*[qcol(n) for n in names]).alias(target))
        else:
            out.append(qcol(names[0]).alias(target))
    return df.select(*out)


def clean_strings(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Null out empty, ``N/A`` and ``DUMMY`` (any case) in the string columns."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return replace_columns(df, {c: hw.clean_string(qcol(c)) for c in cols})


def normalize_memory(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return replace_columns(df, {c: hw.memory_gb(qcol(c)) for c in cols or MEMORY_COLUMNS})


def normalize_datetime(df: DataFrame, col: str = "datetime", helper: str | None = None) -> DataFrame:
    """ISO text in ``col``; a frame without the column passes unchanged.

    ``helper`` names an extra timestamp column made from the ISO text.
    """
    if col not in df.columns:
        return df
    out = replace_columns(df, {col: hw.datetime_iso(qcol(col))})
    return out.withColumn(helper, qcol(col).try_cast("timestamp")) if helper else out


def normalize_frequency(df: DataFrame, col: str = "system.cpu.frequency") -> DataFrame:
    return replace_columns(df, {col: hw.frequency_ghz(qcol(col))})


def cast_columns(df: DataFrame, spec: dict[str, str] | None = None, strict: bool = False) -> DataFrame:
    """Cast columns; unreadable text becomes null, or fails the job when ``strict``."""
    spec = spec or {c: "long" for c in INTEGER_COLUMNS}
    return replace_columns(
        df, {c: qcol(c).cast(t) if strict else qcol(c).try_cast(t) for c, t in spec.items()}
    )


def normalize_interconnect(df: DataFrame, cols: list[str] | None = None) -> DataFrame:
    return replace_columns(df, {c: hw.interconnect(qcol(c)) for c in cols or INTERCONNECT_COLUMNS})


def sort_columns(df: DataFrame) -> DataFrame:
    """Columns in code-point order."""
    return df.select(*[qcol(c) for c in sorted(df.columns)])


def drop_null_fields(record: Column, fields: list[str], fallback: Column | None = None) -> dict[str, Column]:
    """Non-null fields of ``record``, filled from ``fallback`` where they are null."""
    if fallback is None:
        return {f: record[f] for f in fields}
    return {f: F.coalesce(record[f], fallback[f]) for f in fields}


def _checks() -> list[tuple[str, str, Callable[[Column], Column]]]:
    """(category, column, rule) of the quality report."""
    return [
        ("datetime_values", "datetime", hw.datetime_iso),
        ("frequency_values", "system.cpu.frequency", hw.frequency_ghz),
        ("accelerator_vendors", ACCELERATOR, lambda c: hw.keyword_class(c, hw.ACCELERATOR_VENDORS)),
        ("cpu_vendors", "system.cpu.model", lambda c: hw.keyword_class(c, hw.CPU_VENDORS)),
        *[("interconnect_types", c, hw.interconnect) for c in INTERCONNECT_COLUMNS],
        *[(f"memory:{c}", c, hw.memory_gb) for c in MEMORY_COLUMNS],
        *[(f"integer:{c}", c, lambda x: x.try_cast("long")) for c in INTEGER_COLUMNS],
    ]


def reported_columns() -> list[str]:
    """The columns that :func:`quality_report` reads."""
    return sorted({c for _, c, _ in _checks()})


def quality_report(df_raw: DataFrame, prices: DataFrame | None = None) -> DataFrame:
    """Distinct values the cleaning rules could not resolve, with row counts.

    ``df_raw`` is the table after alias resolution. One scan, one aggregation: each row emits its raw values, which are
    counted before the shuffle; the rules then meet every distinct value once. With ``prices`` each row also emits its
    accelerator name, and priced names leave the counted result.
    """
    df = conform(df_raw)
    checks = [(category, c, lambda v, resolve=resolve: resolve(v).isNull()) for category, c, resolve in _checks()]
    if prices is not None:
        checks.append((UNPRICED, ACCELERATOR, lambda v: F.lit(True)))
    # A column may have several checks; its values are counted once.
    columns = list(dict.fromkeys(c for _, c, _ in checks))
    kinds = dict(df.dtypes)
    emitted = [F.struct(F.lit(k).alias("k"), qcol(c).cast("string").alias("value")) for k, c in enumerate(columns)]
    counts = (
        df.select(F.explode(F.array(*emitted)).alias("e"))
        .where(F.col("e.value").isNotNull())
        .groupBy("e.k", "e.value")
        .agg(F.count(F.lit(1)).alias("rows"))
    )
    cleaned = clean_strings(counts.select("k", F.col("value").alias("_clean"), "rows"), ["_clean"]).where(F.col("_clean").isNotNull())
    # Categories of an unresolved value: those of its column whose rule has no answer.
    issues = [
        F.when((F.col("k") == columns.index(c)) & unresolved(F.col("_clean").cast(kinds[c])), F.lit(category))
        for category, c, unresolved in checks
    ]
    report = cleaned.select(F.explode(F.array_compact(F.array(*issues))).alias("category"), F.col("_clean").alias("value"), "rows")
    if prices is None:
        return report
    priced = prices.select(F.col("name").alias("_name"), F.lit(UNPRICED).alias("_category"))
    return report.join(priced, (F.col("category") == F.col("_category")) & (F.col("value") == F.col("_name")), "left_anti")
