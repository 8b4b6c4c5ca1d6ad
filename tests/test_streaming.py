"""Streams equal their batch forms, drop late rows and survive restarts."""

import json

import pytest
from pyspark.sql import functions as F

from inferlytics.operators import metrics
from inferlytics.operators.runs import merge_runs
from inferlytics.sources.readers import read_run_directories
from inferlytics.streaming import streams

MINUTE = 60_000_000


def files_of(spark, path, batches, schema):
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{path}/b{i}")
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(path))


def test_windowed_metrics_equal_batch_and_drop_late_rows(spark, tmp_path):
    schema = "us long, latency_s double, prompt_len int, output_tokens int"
    early = [(i * MINUTE, 0.1 * i, 5, i % 3) for i in range(1, 50)]
    later = [(i * MINUTE, 0.2, 5, 2) for i in range(600, 650)]
    late = [(3 * MINUTE, 9.0, 5, 2)]
    path = tmp_path / "in"
    query_rows = []
    for i, rows in enumerate([early, later, late]):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/b{i}")
        source = spark.readStream.schema(schema).option("recursiveFileLookup", True).parquet(str(path))
        stream = streams.stream_request_metrics(source.withColumn("start_ts", F.timestamp_micros("us")), "30 minutes", "1 minute")
        writer = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True)
        seen = []
        writer.foreachBatch(lambda df, n, seen=seen: seen.extend(df.collect())).start().awaitTermination()
        query_rows += seen
    got = {r["window_start"]: r for r in query_rows}
    batch = spark.createDataFrame(early + later, schema).withColumn("start_ts", F.timestamp_micros("us"))
    want = {r["window_start"]: r for r in streams.stream_request_metrics(batch, "30 minutes", "1 minute").collect()}
    assert set(got) == set(want) and len(want) == 4
    for k, r in want.items():
        assert got[k]["completed"] == r["completed"] and got[k]["total_samples"] == r["total_samples"]
        assert abs(got[k]["mean_latency_ns"] - r["mean_latency_ns"]) < 1 and got[k]["p90_latency_ns"] == r["p90_latency_ns"]


def test_sliding_windows(spark):
    rows = spark.createDataFrame([(i * MINUTE, 0.5, 1, 1) for i in range(10)], "us long, latency_s double, prompt_len int, output_tokens int")
    out = streams.stream_request_metrics(rows.withColumn("start_ts", F.timestamp_micros("us")), "4 minutes", slide="2 minutes")
    assert sum(r["completed"] for r in out.collect()) == 20


def test_token_latency_across_batches(spark, tmp_path):
    schema = "r string, seq long, us long, text string, done boolean"
    one = [("a", 0, 5, "x", False), ("a", 2, 40, "z", False), ("b", 0, 7, "", False), ("b", 1, 9, "q", False), ("e", 0, 1, "", False)]
    two = [("a", 1, 20, "y", False), ("a", 3, 41, "", True), ("c", 0, 3 * 3600 * 10**6, "w", True)]
    three = [("d", 0, 9 * 3600 * 10**6, "v", True)]
    source = files_of(spark, tmp_path / "in", [one, two, three], schema)
    chunks = source.select("r", "text", "done", F.timestamp_micros("us").alias("chunk_ts"), F.timestamp_micros(F.lit(0)).alias("request_start"))
    out = streams.replay(spark, streams.stream_token_latency(chunks, ["r"], "1 minute", "1 hour"), "tokens")
    got = {r["r"]: r for r in out.collect()}
    assert {k: r["closed_by"] for k, r in got.items()} == {"a": "marker", "b": "timeout", "c": "marker", "d": "marker"}
    rows = spark.createDataFrame(one + two + three, schema).select(
        "r", "text", F.timestamp_micros("us").alias("chunk_ts"), F.timestamp_micros(F.lit(0)).alias("request_start")
    )
    for want in metrics.request_tokens(rows, ["r"]).collect():
        mine = got[want["r"]]
        assert [mine[c] for c in ("ttft_s", "latency_s", "output_tokens", "tpot_s")] == [want[c] for c in ("ttft_s", "latency_s", "output_tokens", "tpot_s")]


def test_late_chunks_open_no_second_row(spark, tmp_path):
    """After a marker and after a timeout; once the mark is gone the same key is a new request."""
    schema = "r string, us long, text string, done boolean"
    hour = 3600 * 10**6
    batches = [
        [("a", 5, "x", True), ("b", 9, "q", False)],
        [("t1", 3 * hour // 2, "t", True)],
        [("a", 3 * hour // 2, "late", False), ("a", 3 * hour // 2, "late", True)],
        [("t2", 3 * hour, "t", True)],  # time passes: b ends by its timer, the mark of a goes
        [("b", 3 * hour, "late", False)],
        [("t3", 9 * hour, "t", True)],  # the mark of b goes
        [("a", 9 * hour, "anew", True), ("b", 9 * hour, "anew", True)],
    ]
    source = files_of(spark, tmp_path / "in", batches, schema)
    chunks = source.select("r", "text", "done", F.timestamp_micros("us").alias("chunk_ts"), F.timestamp_micros(F.lit(0)).alias("request_start"))
    rows = streams.replay(spark, streams.stream_token_latency(chunks, ["r"], "1 minute", "2 hours"), "late").collect()
    assert sorted((r["r"], r["ttft_s"], r["output_tokens"], r["closed_by"]) for r in rows) == [
        ("a", 5e-6, 1, "marker"), ("a", 32400.0, 1, "marker"), ("b", 9e-6, 1, "timeout"), ("b", 32400.0, 1, "marker"),
        ("t1", 5400.0, 1, "marker"), ("t2", 10800.0, 1, "marker"), ("t3", 32400.0, 1, "marker"),
    ]


def test_token_sessions_close_by_marker_and_by_timeout(spark, tmp_path):
    schema = "r string, us long, text string, done boolean"
    hour = 3600 * 10**6
    one = [("a", 5, "x", False), ("a", 40, "z", True), ("b", 9, "q", False), ("e", 1, "", False)]
    two = [("b", hour // 2, "q", False), ("c", 2 * hour, "w", True)]
    three = [("d", 9 * hour, "v", False)]
    source = files_of(spark, tmp_path / "in", [one, two, three], schema)

    def shape(df):
        return df.select("r", "text", "done", F.timestamp_micros("us").alias("chunk_ts"), F.timestamp_micros(F.lit(0)).alias("request_start"))

    out = streams.replay(spark, streams.stream_token_sessions(shape(source), ["r"], "1 minute", "1 hour"), "sessions")
    got = {r["r"]: r for r in out.collect()}
    assert sorted(got) == ["a", "b", "c"]  # d is still open
    table = spark.createDataFrame(one + two, schema)
    for want in metrics.request_tokens(shape(table), ["r"]).collect():
        assert [got[want["r"]][c] for c in ("ttft_s", "latency_s", "output_tokens", "tpot_s")] == [want[c] for c in ("ttft_s", "latency_s", "output_tokens", "tpot_s")]
    batch = streams.stream_token_sessions(shape(spark.createDataFrame(one + two + three, schema)), ["r"])
    assert sorted(r["r"] for r in batch.collect()) == ["a", "b", "c", "d"]


def test_run_stream_merges_halves_and_restarts(spark, tmp_path):
    base, table, check = tmp_path / "runs", str(tmp_path / "table"), str(tmp_path / "check")

    def put(run, kind, doc):
        path = base / run / kind
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(json.dumps(doc))

    put("20250101-000000", "performance/benchmark_results.json", {"samples_per_second": 3.0})
    streams.stream_runs(spark, str(base), table, check).awaitTermination()
    assert streams.merged_runs(spark, table).first()["mode"] == "PerformanceOnly"
    put("20250101-000000", "accuracy/accuracy_results.json", {"rouge1": 1.5})
    put("20250102-000000", "accuracy/benchmark_results.json", {"rouge1": 0.5})
    streams.stream_runs(spark, str(base), table, check).awaitTermination()
    streams.stream_runs(spark, str(base), table, check).awaitTermination()
    got = sorted(map(str, streams.merged_runs(spark, table).collect()))
    assert got == sorted(map(str, merge_runs(*read_run_directories(spark, str(base))).collect()))
    assert spark.read.parquet(table).count() == 3


def test_a_request_asks_the_state_store_at_most_three_times():
    """One question for the state, one timer, one write; a timer is replaced by its name, timers are never listed."""
    from unittest.mock import MagicMock

    import pandas as pd

    def rows(us):
        return iter([pd.DataFrame({"us": [float(us)], "start_us": [0.0], "has_text": [True], "done": [False]})])

    now = MagicMock()
    now.getCurrentWatermarkInMs.return_value = 0
    requests = streams._Requests(1000, ["r", "ttft_s", "latency_s", "output_tokens", "tail_s", "closed_by"])
    handle = MagicMock()
    requests.init(handle)
    state = handle.getValueState.return_value
    state.get.return_value = None
    assert [*requests.handleInputRows(("a",), rows(5000), now)] == []
    kept = state.update.call_args.args[0]
    assert kept == (5000.0, 5000.0, 0.0, 1, False, 1005) and handle.registerTimer.call_args.args == (1005,)
    assert len(handle.mock_calls) <= 4 and not handle.listTimers.called and not state.exists.called  # with getValueState
    state.get.return_value = kept
    assert [*requests.handleInputRows(("a",), rows(9000), now)] == []
    assert handle.deleteTimer.call_args.args == (1005,) and handle.registerTimer.call_args.args == (1009,)


class Store:
    """A state store of one key; counts what it is asked."""

    def __init__(self):
        self.value, self.timers, self.asked = None, set(), 0

    def getValueState(self, name, schema):
        return self

    def get(self):
        self.asked += 1
        return self.value

    def update(self, value):
        self.asked, self.value = self.asked + 1, value

    def clear(self):
        self.asked, self.value = self.asked + 1, None

    def registerTimer(self, at):
        self.asked += 1
        self.timers.add(at)

    def deleteTimer(self, at):
        self.asked += 1
        self.timers.remove(at)


NAMES = ["request", "ttft_s", "latency_s", "output_tokens", "tail_s", "closed_by"]


def replayed(processor, batches, key):
    """Rows of a processor over (watermark, chunks) batches, timers after rows, and the most questions of one call."""
    from unittest.mock import MagicMock

    import pandas as pd

    held, rows, most = {}, [], 0
    for now, chunks in batches:
        clock = MagicMock()
        clock.getCurrentWatermarkInMs.return_value = now
        frame = pd.DataFrame(chunks, columns=["request", "us", "start_us", "has_text", "done"])
        calls = [(k, lambda p, k, part=part: p.handleInputRows((k,), iter([part[:2], part[2:]] if len(part) > 2 else [part]), clock)) for k, part in frame.groupby(frame["request"].map(key))]
        for timers in (False, True):
            if timers:
                calls = [(k, lambda p, k, at=at: p.handleExpiredTimer((k,), clock, at)) for k, s in held.items() for at in sorted(s.timers) if at <= now]
            for k, call in calls:
                store = held.setdefault(k, Store())
                before, due = store.asked, {t for t in store.timers if t <= now} if timers else set()
                one = processor(3000, NAMES)
                one.init(store)
                for out in call(one, k):
                    rows += [(now, *r) for r in out.itertuples(index=False, name=None)]
                store.timers -= due
                most = max(most, store.asked - before)
    return sorted(rows), most


@pytest.mark.parametrize("buckets", [1, 3])
def test_buckets_give_the_rows_of_single_requests(buckets):
    import random

    rng, batches, now = random.Random(buckets), [], 0
    for _ in range(60):
        chunks = []
        for _ in range(rng.randrange(1, 40)):
            at = max(0, now + rng.randrange(4000)) * 1000.0
            chunks.append((f"r{rng.randrange(30)}", at, at - rng.randrange(5000), rng.random() < 0.8, rng.random() < 0.1))
        batches.append((now, chunks))
        now += rng.choice([0, 500, 1500, 4000])
    batches.append((now + 10**6, [("end", (now + 10**6) * 1000.0, 0.0, True, False)]))
    single, _ = replayed(streams._Requests, batches, lambda r: r)
    together, most = replayed(streams._Buckets, batches, lambda r: int(r[1:]) % buckets if r != "end" else -1)
    assert together == single and len(together) > 100
    assert most <= 4  # whatever the number of requests: state, old timer, new timer, state


def test_token_stream_keeps_the_types_of_its_keys(spark, tmp_path):
    import datetime

    schema = "r long, at timestamp, us long, text string, done boolean"
    at = datetime.datetime(2024, 1, 2, 3, 4, 5, 678901)
    rows = [(2**60 + 1, at, 5, "x", True), (None, at, 7, "x", True), (None, None, 9, "x", True)]
    untimed = [(7, at, None, "x", True), (None, None, None, "x", False)]
    source = files_of(spark, tmp_path / "in", [rows + untimed], schema)
    chunks = source.select("r", "at", "text", "done", F.timestamp_micros("us").alias("chunk_ts"), F.timestamp_micros(F.lit(0)).alias("request_start"))
    for buckets in (2, None):
        out = streams.replay(spark, streams.stream_token_latency(chunks, ["r", "at"], buckets=buckets), f"typed-{buckets}")
        assert {(r["r"], r["at"], r["ttft_s"]) for r in out.collect()} == {(r, t, us / 1e6) for r, t, us, *_ in rows}
