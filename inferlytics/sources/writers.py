"""Sinks: distributed files, one directory per table."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.ranks import settled
from ..operators.runs import run_summary
from ..schema import qcol

# Every JSON line repeats all names, so its text shrinks to a fraction; the quick level costs little beside the cleaning.
COMPRESSED = {"json": {"compression": "gzip", "zlib.compress.level": "BEST_SPEED"}, "parquet": {"compression": "zstd"}}


def write_results(
    df: DataFrame, path: str, formats: tuple[str, ...] = ("json", "parquet"), partition_by: list[str] = [], mode: str = "errorifexists"
) -> None:
    """Result table as Parquet and as JSON lines, each in its own directory.

    The table is worked out once: Parquet is written first and the other formats are written from it. Where that folder may
    hold other rows (``append``, ``ignore``), or Parquet is not wanted, several formats share a copy in the shared folder.
    Files are compressed; a file of JSON lines is read by one task, as it was written by one.
    """
    source = df
    if len(formats) > 1 and not ("parquet" in formats and mode in ("errorifexists", "error", "overwrite")):
        source = settled(df, "results")
    for fmt in sorted(formats, key=lambda f: f != "parquet"):
        source.write.mode(mode).partitionBy(*partition_by).options(**COMPRESSED.get(fmt, {})).format(fmt).save(f"{path}/{fmt}")
        if source is df and len(formats) > 1:
            source = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{fmt}").select(*[qcol(c) for c in df.columns])


def write_runs(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Merged runs as JSON lines; returns the counts, taken from what was written."""
    df.write.mode(mode).json(path)
    return run_summary(df.sparkSession.read.schema(df.schema).json(path))


def write_accuracy(details: DataFrame, metrics: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Per-sample records and the corpus record."""
    details.write.mode(mode).json(f"{path}/accuracy_details")
    metrics.write.mode(mode).json(f"{path}/accuracy_results")


def write_ordered(df: DataFrame, path: str, order: list[str], mode: str = "errorifexists") -> None:
    """Globally ordered files: range partitions by ``order``, sorted inside."""
    keys = [qcol(c) for c in order]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode(mode).parquet(path)
