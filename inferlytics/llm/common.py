"""Shared folder, written intermediate tables, row keys and match positions."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENTS = ("doc_id", "text", "lang", "source", "n_chars")
BROADCAST_KEYS = 3_000_000  # rows of an id and a hash that are sent to every executor, some 300 MB


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``, which driver and executors share.

    Only a ``local`` master, where there is one machine, may leave the setting out.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "")
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def settle(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: cuts lineage, survives lost executors."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """64-bit hash of a text; with the id it names a row (rows equal in both are repeats of one row)."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, text_key) that also matches null ids."""
    return (left["text_key"] == right["text_key"]) & left["doc_id"].eqNullSafe(right["doc_id"])


def beside_texts(keys: DataFrame, name: str, most: int = BROADCAST_KEYS) -> DataFrame:
    """Keys for a join with texts, written and counted: up to ``most`` are broadcast, so that the texts stay where they
    are; for more, Spark chooses the join, which may shuffle the texts."""
    keys = settle(keys, name)
    return F.broadcast(keys) if keys.count() <= most else keys


def keep_rows(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """Semi or anti join of documents with a table of (doc_id, text_key); other columns are untouched."""
    keys = beside_texts(keys.select(F.col("doc_id").alias("_key_id"), F.col("text_key").alias("_key_hash")), "row-keys")
    on = (text_key(docs["text"]) == keys["_key_hash"]) & docs["doc_id"].eqNullSafe(keys["_key_id"])
    return docs.join(keys, on, how)


def documents_only(docs: DataFrame) -> DataFrame:
    return docs.select(*DOCUMENTS)


FOLD = 64  # spans in one fold; an array grows by copying, so long runs are cut


def find_spans(text: Column, pattern: str, gate: Column | None = None, near: int = 0) -> Column:
    """All leftmost non-overlapping matches as array<struct<start,end,value>>, positions in code points.

    With ``near`` also ``left`` and ``right``: up to so many characters before a match, no further than the begin of the
    match before, and the character after it. The pieces between matches give positions and neighbours, so the work grows
    with the text and not with matches times text. ``gate`` is a cheap test; texts that fail it are not searched. A
    pattern must not match the empty string.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.split(text, pattern, -1)
    fields = ["start int", "end int", "value string", *(["left string", "right string"] if near else [])]
    empty = F.array().cast(f"array<struct<{','.join(f.replace(' ', ':') for f in fields)}>>")

    def placed(bound: Column) -> Column:
        vs, ps = bound["values"], bound["pieces"]

        def one(value: Column, i: Column) -> Column:
            before = F.get(ps, i)
            size = F.length(value)
            out = [value.alias("value"), F.length(before).alias("gap"), (F.length(before) + size).alias("size")]
            if near:
                left = F.right(F.concat(F.coalesce(F.get(vs, i - 1), F.lit("")), before), F.lit(near))
                right = F.left(F.concat(F.get(ps, i + 1), F.coalesce(F.left(F.get(vs, i + 1), F.lit(1)), F.lit(""))), F.lit(1))
                out += [left.alias("left"), right.alias("right")]
            return F.struct(*out)

        return F.transform(vs, one)

    def step(state: Column, m: Column) -> Column:
        end = state["at"] + m["size"]
        span = [(state["at"] + m["gap"]).alias("start"), end.alias("end"), m["value"].alias("value")]
        span += [m["left"].alias("left"), m["right"].alias("right")] if near else []
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(*span))).alias("spans"))

    def run(ms: Column, k: Column) -> Column:
        return F.slice(ms, k * FOLD + 1, F.lit(FOLD))

    def folded(bound: Column) -> Column:
        ms, sums = bound["ms"], bound["sums"]

        def fold(k: Column) -> Column:
            at = F.aggregate(F.slice(sums, F.lit(1), k), F.lit(0), lambda a, x: a + x)
            return F.aggregate(run(ms, k), F.struct(at.alias("at"), empty.alias("spans")), step, lambda s: s["spans"])

        return F.flatten(F.transform(_runs(ms), fold))

    def summed(ms: Column) -> Column:
        sums = F.transform(_runs(ms), lambda k: F.aggregate(run(ms, k), F.lit(0), lambda a, m: a + m["size"]))
        return F.struct(ms.alias("ms"), sums.alias("sums"))

    found = _bind(F.struct(values.alias("values"), pieces.alias("pieces")), placed)
    found = _bind(_bind(found, summed), folded)
    hit = text.rlike(pattern) if gate is None else gate
    return F.when(hit, F.coalesce(found, empty)).otherwise(empty)


def _runs(items: Column) -> Column:
    """Numbers of the runs of ``FOLD`` items; one run, which is empty, of no items."""
    return F.sequence(F.lit(0), F.floor(F.greatest(F.size(items) - 1, F.lit(0)) / FOLD).cast("int"))


def _bind(value: Column, body) -> Column:
    """``body`` of ``value``, which is evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of each struct, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def only(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns, whatever else the table carries."""
    return df.select(*[F.col(f"`{n}`") for n in names])
