"""Windowed request metrics, stateful token latency, arriving run files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.runs import merge_runs
from ..schema import struct
from ..sources.readers import parse_run_files, run_halves
from .storage import shared_folder


def stream_request_metrics(
    events: DataFrame, window: str = "1 day", watermark: str = "1 hour", slide: str | None = None,
    run_keys: list[str] = [], accuracy: int = 10000,
) -> DataFrame:
    """Request metrics per window over a stream (or a table).

    Needs ``start_ts`` (timestamp), ``latency_s``, ``prompt_len``, ``output_tokens``. Rows later than
    the watermark are dropped. Percentiles are sketches of bounded size, since the state of
    an open window must not grow with its rows.
    """
    ok = F.col("output_tokens") > 0
    latency = F.when(ok, F.col("latency_s") * 1e9)
    span = F.window("start_ts", window, slide) if slide else F.window("start_ts", window)
    start_s = F.unix_micros("start_ts") / 1e6
    seconds = F.col("_end") - F.col("_start")
    return (
        events.withWatermark("start_ts", watermark)
        .groupBy(span.alias("w"), *run_keys)
        .agg(
            F.count_if(ok).alias("completed"),
            F.count(F.lit(1)).alias("total_samples"),
            F.sum(F.when(ok, F.col("prompt_len") + F.col("output_tokens"))).alias("tokens"),
            F.avg(latency).alias("mean_latency_ns"),
            F.percentile_approx(latency, F.array(F.lit(0.5), F.lit(0.9), F.lit(0.99)), accuracy).alias("_p"),
            F.min(start_s).alias("_start"),
            F.max(start_s + F.col("latency_s")).alias("_end"),
        )
        .select(
            F.col("w.start").alias("window_start"),
            F.col("w.end").alias("window_end"),
            *run_keys,
            "completed",
            "total_samples",
            F.coalesce(F.try_divide(F.col("completed"), seconds), F.lit(0.0)).alias("samples_per_second"),
            F.coalesce(F.try_divide(F.col("tokens"), seconds), F.lit(0.0)).alias("tokens_per_second"),
            F.coalesce("mean_latency_ns", F.lit(0.0)).alias("mean_latency_ns"),
            *[F.coalesce(F.get("_p", F.lit(i)), F.lit(0.0)).alias(f"{p}_latency_ns") for i, p in enumerate(["p50", "p90", "p99"])],
        )
    )


def stream_token_sessions(
    chunks: DataFrame, request_keys: list[str], watermark: str = "10 minutes", timeout: str = "1 hour"
) -> DataFrame:
    """One row per request, built-in operators only: TTFT, latency, tokens, TPOT.

    A request is a session of its chunks. The chunk whose ``done`` is true keeps the session
    open for no longer than itself, every other one for ``timeout``. Rows appear in append
    mode once the watermark has passed the end of the session, so a finished request waits
    for the watermark; :func:`stream_token_latency` reports it at its marker, at the cost of a
    Python call per request. Works on a table as well.
    """
    gap = F.when(F.coalesce(F.col("done"), F.lit(False)), F.lit("1 microsecond")).otherwise(F.lit(timeout))
    us = F.unix_micros("chunk_ts")
    told = F.length("text") > 0
    first, last, start = F.min(F.when(told, us)), F.max(F.when(told, us)), F.unix_micros(F.min("request_start"))
    return (
        chunks.withWatermark("chunk_ts", watermark)
        .groupBy(*request_keys, F.session_window("chunk_ts", gap).alias("_session"))
        .agg(
            ((first - start) / 1e6).alias("ttft_s"),
            ((last - start) / 1e6).alias("latency_s"),
            F.count_if(told).alias("output_tokens"),
            ((last - first) / 1e6).alias("_tail_s"),
        )
        .where(F.col("output_tokens") > 0)
        .withColumn("tpot_s", F.when(F.col("output_tokens") > 1, F.col("_tail_s") / (F.col("output_tokens") - 1)))
        .drop("_session", "_tail_s")
    )


TOKEN_STATE = struct(first_us="double", last_us="double", start_us="double", tokens="long", closed="boolean", wake_ms="long")
BUCKET_STATE = struct(held="binary", wake_ms="long")
TOKEN_FOLD = {"first": "min", "last": "max", "start": "min", "tokens": "sum", "done": "max"}
STAMPS = {f"timestamp{kind}Format": f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS{zone}" for kind, zone in (("", "XXX"), ("NTZ", ""))}
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Requests(StatefulProcessor):
    """Folds the chunks of a request and reports it once, at its marker or by a timer.

    A closed request leaves a mark for another ``limit_ms`` of event time, so that a late chunk does not open it again;
    then a timer removes the mark. The state names its timer, so that a call asks for the state once and never lists timers;
    every question to the store costs more than the fold of a request's rows.
    """

    def __init__(self, limit_ms: int, names: list[str]):
        self.limit_ms, self.names = limit_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", TOKEN_STATE)

    def _keep(self, fold: tuple, closed: bool, at_ms: int, wake: int | None, now: int) -> None:
        at_ms = max(at_ms, now + 1)
        if wake != at_ms:
            if wake is not None:
                self.handle.deleteTimer(wake)
            self.handle.registerTimer(at_ms)
        self.state.update((*fold, closed, at_ms))

    def _close(self, key: tuple, fold: tuple, ended: str, wake: int | None, now: int) -> list:
        first, last, start, tokens = fold
        seen = max(last, start) if tokens else start
        self._keep(fold, True, max(int(seen / 1000), now) + self.limit_ms, wake, now)
        return [[*key, (first - start) / 1e6, (last - start) / 1e6, tokens, (last - first) / 1e6, ended]] if tokens else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, wake = self.state.get(), None
        fold, closed, out = (float("inf"), float("-inf"), float("inf"), 0), False, []
        if held is not None:
            *was, closed, wake = held
            if wake > now:
                fold = tuple(was)
            elif closed:  # the mark is due, and timers come after rows: this is a new request
                closed = False
            else:
                out, closed = self._close(key, tuple(was), "timeout", wake, now), True
        first, last, start, tokens = fold
        done = False
        for frame in rows:
            told = frame["us"].to_numpy()[frame["has_text"].to_numpy(dtype=bool)]
            if told.size:
                first, last = min(first, told.min()), max(last, told.max())
            start, tokens = min(start, frame["start_us"].to_numpy().min()), tokens + told.size
            done = done or bool(frame["done"].to_numpy(dtype=bool).any())
        if not closed:
            fold = (float(first), float(last), float(start), int(tokens))
            if done:
                out = self._close(key, fold, "marker", wake, now)
            else:
                self._keep(fold, False, int((last if tokens else start) / 1000) + self.limit_ms, wake, now)
        if out:
            yield pd.DataFrame(out, columns=self.names)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        *fold, closed, wake = self.state.get() or (None, 1 << 62)
        if wake > now:
            return
        if closed:
            self.state.clear()
        elif out := self._close(key, tuple(fold), "timeout", None, now):  # Spark removes the timer that went off
            yield pd.DataFrame(out, columns=self.names)

    def close(self) -> None:
        pass


class _Buckets(StatefulProcessor):
    """:class:`_Requests` for all requests of a bucket at once, with the same rows.

    The bucket has one value of state and one timer, for the first of its requests that is due, since every question to the
    store and every call costs more than the folds of many requests.
    """

    def __init__(self, limit_ms: int, names: list[str]):
        self.limit_ms, self.names = limit_ms, names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("requests", BUCKET_STATE)

    def _load(self) -> tuple[pd.DataFrame, int | None]:
        if (value := self.state.get()) is None:
            kinds = {"first": "f8", "last": "f8", "start": "f8", "tokens": "i8", "closed": "?", "wake": "i8"}
            return pd.DataFrame({c: pd.Series(dtype=k) for c, k in kinds.items()}, index=pd.Index([], dtype=object)), None
        with pa.ipc.open_stream(value[0]) as stream:
            return stream.read_all().to_pandas().set_index("request"), value[1]

    def _save(self, held: pd.DataFrame, timer: int | None) -> None:
        wake = int(held["wake"].min()) if len(held) else None
        if wake != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            if wake is not None:
                self.handle.registerTimer(wake)
        if wake is None:
            self.state.clear()
            return
        table, sink = pa.Table.from_pandas(held.rename_axis("request").reset_index(), preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.state.update((sink.getvalue().to_pybytes(), wake))

    def _close(self, ended: pd.DataFrame, how: str, now: int) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
        """The requests as marks, and their rows."""
        seen = np.where(ended["tokens"] > 0, np.fmax(ended["last"], ended["start"]), ended["start"])
        wake = np.maximum(_ms(seen), now) + self.limit_ms
        marks = ended.assign(closed=True, wake=np.maximum(wake, now + 1))
        told = ended[ended["tokens"] > 0]
        first, last, start = told["first"], told["last"], told["start"]
        columns = [told.index, (first - start) / 1e6, (last - start) / 1e6, told["tokens"], (last - first) / 1e6, how]
        rows = pd.DataFrame(dict(zip(self.names, columns, strict=True)), columns=self.names)
        return marks, [rows.reset_index(drop=True)] if len(rows) else []

    def _due(self, held: pd.DataFrame, now: int) -> tuple[pd.DataFrame, list[pd.DataFrame]]:
        """Drops marks that are due, closes requests that are due."""
        due = held["wake"] <= now
        marks, out = self._close(held[due & ~held["closed"]], "timeout", now)
        return pd.concat([held[~due], marks]) if len(marks) else held[~due], out

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, timer = self._load()
        new = pd.concat([_fold_chunks(frame) for frame in rows]).groupby(level=0, sort=False).agg(TOKEN_FOLD)
        held, out = self._due(held, now)  # first, since timers come after rows
        new = new[~new.index.isin(held.index[held["closed"]])]
        known = held.index.isin(new.index)
        fold = {c: how for c, how in TOKEN_FOLD.items() if c != "done"}
        both = pd.concat([held.loc[known, list(fold)], new[list(fold)]]) if known.any() else new[list(fold)]
        both = both.groupby(level=0, sort=False).agg(fold)
        done = new["done"].reindex(both.index).to_numpy(bool)
        seen = np.where(both["tokens"] > 0, both["last"], both["start"])
        opened = both.assign(closed=False, wake=np.maximum(_ms(seen) + self.limit_ms, now + 1))
        marks, ended = self._close(opened[done], "marker", now)
        self._save(pd.concat([x for x in (held[~known], opened[~done], marks) if len(x)] or [held[:0]]), timer)
        yield from out + ended

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        held, timer = self._load()
        if timer is None or timer > now:
            return
        held, out = self._due(held, now)
        self._save(held, None)  # Spark removes the timer that went off
        yield from out

    def close(self) -> None:
        pass


def _ms(us: np.ndarray) -> np.ndarray:
    return np.trunc(np.nan_to_num(us, nan=0.0, neginf=0.0) / 1000).astype("i8")


def _fold_chunks(frame: pd.DataFrame) -> pd.DataFrame:
    """First and last token, start, tokens and marker of each request of a frame."""
    told = frame["has_text"].astype(bool)
    us, start = frame["us"], frame["start_us"]
    chunks = {"first": us.where(told, np.inf), "last": us.where(told, -np.inf), "start": start, "tokens": told.astype("i8"), "done": frame["done"].astype(bool)}
    return pd.DataFrame(chunks).groupby(frame["request"].rename(None), sort=False).agg(TOKEN_FOLD)


def stream_token_latency(
    chunks: DataFrame, request_keys: list[str], watermark: str = "10 minutes", timeout: str = "1 hour",
    buckets: int | None = 2048,
) -> DataFrame:
    """One row per finished request: TTFT, latency, tokens, TPOT.

    A request ends with a chunk whose ``done`` is true or, since that chunk may never come,
    when event time passes its last chunk by ``timeout``; what comes for it within ``timeout`` after that is dropped. The
    state is five numbers and a mark per request and depends neither on the order of chunks inside a batch nor on their
    number. It lies in ``buckets`` of requests, or with None in one place per request, at a Python call for each; a restart
    needs the same number. Needs ``chunk_ts``, ``request_start`` (timestamps), ``text``, ``done``. A chunk without a
    time lies nowhere in the stream and is left out; null keys are a request like any other. Timers need a state store
    that has them, so the session is set to the RocksDB store.
    """
    chunks.sparkSession.conf.set(STATE_STORE, ROCKS_DB)
    limit_ms = int(pd.Timedelta(timeout).total_seconds() * 1000)
    keys = T.StructType([chunks.schema[k] for k in request_keys])
    out = T.StructType().add("request", "string")
    for name, kind in (("ttft_s", "double"), ("latency_s", "double"), ("output_tokens", "long"), ("tail_s", "double"), ("closed_by", "string")):
        out = out.add(name, kind)
    folded = (
        chunks.withWatermark("chunk_ts", watermark)
        .where(F.col("chunk_ts").isNotNull())
        .select(
            F.to_json(F.struct(*request_keys), STAMPS).alias("request"),
            "chunk_ts",
            F.unix_micros("chunk_ts").cast("double").alias("us"),
            F.unix_micros("request_start").cast("double").alias("start_us"),
            F.coalesce(F.length("text") > 0, F.lit(False)).alias("has_text"),
            F.coalesce(F.col("done"), F.lit(False)).alias("done"),
        )
    )
    if buckets is None:
        dealt, processor = folded.groupBy("request"), _Requests
    else:
        dealt = folded.withColumn("bucket", F.pmod(F.xxhash64("request"), F.lit(buckets))).groupBy("bucket")
        processor = _Buckets
    folded = dealt.transformWithStateInPandas(processor(limit_ms, out.names), out, "append", "EventTime")
    folded = folded.withColumn("request", F.from_json("request", keys, STAMPS))
    per_token = F.when(F.col("output_tokens") > 1, F.col("tail_s") / (F.col("output_tokens") - 1))
    return folded.select("request.*", "ttft_s", "latency_s", "output_tokens", per_token.alias("tpot_s"), "closed_by")


def stream_runs(spark: SparkSession, base: str, table: str, checkpoint: str):
    """Start a stream that appends arriving run files to a Parquet table and stops when done.

    Halves of a run may come in different batches; :func:`merged_runs` joins them on read,
    so the sink is append-only and a restart adds nothing twice.
    """
    files = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", True)
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", "*_results.json")
        .load(base)
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    return (
        parse_run_files(files)
        .writeStream.format("parquet")
        .option("path", table)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )


def merged_runs(spark: SparkSession, table: str) -> DataFrame:
    """Runs of the table written by :func:`stream_runs`."""
    return merge_runs(*run_halves(spark.read.parquet(table)))


def replay(spark: SparkSession, stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and return the table it wrote.

    ``update`` results go to one directory per batch, rewritten if the batch is retried;
    the caller takes the latest row per key by the ``batch`` column.
    """
    folder = shared_folder(spark, name)
    out = f"{folder}/out"
    writer = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).outputMode("append").start()
    else:

        def save(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = writer.foreachBatch(save).outputMode(mode).start()
    query.awaitTermination()
    schema = stream.schema if mode == "append" else stream.schema.add("batch", "long")
    return spark.read.schema(schema).parquet(out)


def latest(table: DataFrame, keys: list[str]) -> DataFrame:
    """Newest version of each key of an update-mode replay."""
    values = [c for c in table.columns if c not in keys and c != "batch"]
    newest: Column = F.max_by(F.struct(*values), "batch")
    return table.groupBy(*keys).agg(newest.alias("v")).select(*keys, "v.*")
