"""Distributed ranks, percentiles, gaps and neighbour counts against brute force, with hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferlytics.operators import metrics, ranks, similar
from inferlytics.operators.filters import within_tolerance


@pytest.fixture(scope="module")
def skewed():
    """A third of all rows in one group, many equal values, wide value range, a null key."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c", "d", None])
        v = rng.choice([0.0, 1.5, rng.lognormvariate(0, 4), -rng.random() * 100, rng.lognormvariate(20, 1)])
        rows.append((key, i, v))
    return rows


@pytest.mark.parametrize("partitions", [1, 7])
def test_exact_percentiles(spark, skewed, partitions):
    df = spark.createDataFrame(skewed, "k string, i long, v double").repartition(partitions)
    probs = {"p0": 0.0, "p50": 0.5, "p97": 0.97, "p99_9": 0.999, "p100": 1.0}
    got = {r["k"]: r for r in ranks.exact_percentiles(df, ["k"], {"v": F.col("v"), "neg": -F.col("v")}, probs).collect()}
    for key in {k for k, _, _ in skewed}:
        values = np.array([v for k, _, v in skewed if k == key])
        for stat, p in probs.items():
            assert got[key][f"{stat}_v"] == pytest.approx(np.percentile(values, p * 100), rel=1e-12)
            assert got[key][f"{stat}_neg"] == pytest.approx(np.percentile(-values, p * 100), rel=1e-12)


@pytest.mark.parametrize("scale", [1.0, 1e9, 1e-9])
def test_crowded_ranges_are_cut(spark, skewed, scale, monkeypatch):
    """Groups far above the limit, whatever the unit; a crowded spot; a value a third of all rows."""
    rng = random.Random(11)
    rows = [(k, i, v * scale) for k, i, v in skewed] + [("spot", i, (5 + rng.random() * 1e-7) * scale) for i in range(4000)]
    rows += [("same", i, 3.0 * scale if i % 3 else rng.random() * scale) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i long, v double").repartition(4)
    ranges = []
    cut = ranks._cut_ranges
    monkeypatch.setattr(ranks, "_cut_ranges", lambda *a: ranges.append(1) or cut(*a))
    monkeypatch.setattr(ranks, "SKETCH", 200)
    probs = {"p0": 0.0, "p1": 0.01, "p50": 0.5, "p97": 0.97, "p99_9": 0.999, "p100": 1.0}
    got = {r["k"]: r for r in ranks.exact_percentiles(df, ["k"], {"v": F.col("v"), "neg": -F.col("v")}, probs, most=30).collect()}
    assert ranges
    for key in {k for k, _, _ in rows}:
        values = np.array([v for k, _, v in rows if k == key])
        for stat, p in probs.items():
            assert got[key][f"{stat}_v"] == pytest.approx(np.percentile(values, p * 100), rel=1e-12), (key, stat)
            assert got[key][f"{stat}_neg"] == pytest.approx(np.percentile(-values, p * 100), rel=1e-12), (key, stat)


def test_wrong_sketch_borders_are_noticed(spark, monkeypatch):
    """Borders on the wrong side of a rank are found by counting, and the result stays exact."""
    monkeypatch.setattr(ranks, "MARGIN", -0.2)  # try a range that misses the rank
    df = spark.range(1000).select(F.col("id").cast("double").alias("v"))
    row = ranks.exact_percentiles(df, [], {"v": F.col("v")}, {"p10": 0.1, "p50": 0.5, "p90": 0.9}, most=50).first()
    assert (row["p10_v"], row["p50_v"], row["p90_v"]) == (pytest.approx(99.9), 499.5, pytest.approx(899.1))


def test_percentiles_of_one_value_and_of_nulls(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None), ("c", 1.0), ("c", None)], "k string, v double")
    got = {r["k"]: r["p50_v"] for r in ranks.exact_percentiles(df, ["k"], {"v": F.col("v")}, {"p50": 0.5}).collect()}
    assert got == {"a": 5.0, "c": 1.0}


def test_group_rank(spark, skewed):
    df = spark.createDataFrame(skewed, "k string, i long, v double").repartition(5)
    got = {r["i"]: r["rank"] for r in ranks.group_rank(df, ["k"], ranks.value_range(F.col("v")), [F.col("v"), F.col("i")]).collect()}
    for key in {k for k, _, _ in skewed}:
        order = sorted((v, i) for k, i, v in skewed if k == key)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


@pytest.mark.parametrize("most,ids", [(20, 500), (20, 10**15), (10**6, 500)])
def test_ordered_index(spark, most, ids):
    rng = random.Random(3)
    rows = list({(0 if rng.random() < 0.4 else rng.randrange(ids), rng.randrange(2000)) for _ in range(2000)})
    df = spark.createDataFrame(rows, "a long, b long").repartition(3)
    got = {(r["a"], r["b"]): r["n"] for r in ranks.ordered_index(df, "a", "b", out="n", most=most).collect()}
    assert [got[x] for x in sorted(rows)] == list(range(len(rows)))


@pytest.mark.parametrize("most", [30, 10**6])
def test_progress_marks(spark, most):
    rng = random.Random(5)
    rows = [("hot" if i % 2 else "small" if i % 40 == 0 else "other", i, rng.randrange(10**9)) for i in range(1000)]
    df = spark.createDataFrame(rows, "run_id string, event_id long, end_us long")
    got = metrics.progress_marks(df, most=most).collect()
    for run in {r[0] for r in rows}:
        order = sorted((e, i) for r, i, e in rows if r == run)
        n = len(order)
        marks = [c for c in range(1, n + 1) if c == 1 or c % max(1, n // 10) == 0]
        mine = sorted((g["completed"], g["event_id"], g["percent"]) for g in got if g["run_id"] == run)
        assert mine == [(c, order[c - 1][1], c / n * 100) for c in marks]


@pytest.mark.parametrize("most", [30, 10**6])
def test_token_gaps_cross_stretches(spark, most):
    rng = random.Random(11)
    rows = []
    for request in ("hot", "b", "c"):
        for seq in range(400 if request == "hot" else 20):
            rows.append((request, seq, rng.randrange(10**9), rng.choice(["x", "", "yz"])))
    df = spark.createDataFrame(rows, "r string, seq long, us long, text string").select(
        "r", "seq", "text", F.timestamp_micros("us").alias("chunk_ts"), F.timestamp_micros(F.lit(0)).alias("request_start")
    )
    got = {(g["r"], g["seq"]): g for g in metrics.token_gaps(df, ["r"], most=most).collect()}
    folded = {g["r"]: g for g in metrics.inter_token_latency(df, ["r"], most=most).collect()}
    whole = {g["r"]: g for g in metrics.request_tokens(df, ["r"]).collect()}
    for request in ("hot", "b", "c"):
        told = sorted((us, seq, t) for r, seq, us, t in rows if r == request and t)
        gaps = [(b[0] - a[0]) / 1e6 for a, b in zip(told, told[1:])]
        assert [got[request, seq]["gap_s"] for _, seq, _ in told] == [None, *gaps]
        assert got[request, told[0][1]]["ttft_s"] == told[0][0] / 1e6
        assert folded[request]["itl"] == gaps and folded[request]["generated_text"] == "".join(t for _, _, t in told)
        assert folded[request]["output_tokens"] == whole[request]["output_tokens"] == len(told)
        assert whole[request]["tpot_s"] == pytest.approx((told[-1][0] - told[0][0]) / 1e6 / (len(told) - 1))
    assert len(got) == sum(1 for r in rows if r[3])


def test_stretches_have_equal_counts_whatever_the_span(spark):
    """A run of one minute and one of a year are cut alike; small groups and null keys are not lost."""
    rng = random.Random(23)
    rows = [("minute", rng.randrange(60 * 10**6)) for _ in range(6000)] + [("year", rng.randrange(365 * 86400 * 10**6)) for _ in range(6000)]
    rows += [("one", 5)] * 3000 + [("few", 1), (None, 2)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(3)
    cut = ranks.equal_cuts(df, ["k"], F.col("v"), "n", most=1000).collect()
    assert len(cut) == len(rows)
    for key in ("minute", "year"):
        mine = sorted((r["v"], r["n"]) for r in cut if r["k"] == key)
        assert [n for _, n in mine] == sorted(n for _, n in mine)
        sizes = np.bincount([n for _, n in mine], minlength=ranks.STRETCHES)
        assert (sizes > 0).sum() > 700 and sizes.max() < 60
    assert len({r["n"] for r in cut if r["k"] == "one"}) == 1
    assert {r["n"] for r in cut if r["k"] in ("few", None)} == {0}


@pytest.mark.parametrize("most", [15, 10**6])
def test_similar_counts(spark, most):
    rng = random.Random(13)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.choice([0.0, None, -3.0, 100.0, 90.0, 110.0, round(rng.uniform(50, 150), 1)])) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(5)
    got = {(r["k"], r["v"]): (r["rows"], r["similar_rows"]) for r in similar.similar_counts(df, ["k"], "v", 0.1, most).collect()}
    assert len(got) == len(set(rows))
    for k, v in set(rows):
        near = 0
        if k is not None and v is not None:
            near = sum(1 for kk, x in rows if kk == k and x is not None and v * (1 - 0.1) <= x <= v * (1 + 0.1))
        assert got[k, v] == (rows.count((k, v)), near)


def test_similar_counts_moves_whole_blocks_once(spark):
    """A block that fits a task is shuffled once, before its questions are made, and is not joined to its answers."""
    rows = [(k, float(v)) for k in ("a", "b", None) for v in range(40)]
    plan = similar.similar_counts(spark.createDataFrame(rows, "k string, v double"), ["k"], "v")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("RepartitionByExpression") == 1 and plan.index("Generate") < plan.index("RepartitionByExpression")


def test_similar_counts_of_small_and_cut_blocks(spark):
    rng = random.Random(29)
    rows = [("big", round(rng.uniform(50, 150), 1)) for _ in range(500)] + [("few", float(x)) for x in (0, 9, 10, 11, 11, -4)] + [("few", None), (None, 10.0)]
    df = spark.createDataFrame(rows, "k string, v double").repartition(3)
    got = {(r["k"], r["v"]): r["similar_rows"] for r in similar.similar_counts(df, ["k"], "v", 0.1, 20).collect()}
    near = {(k, v): sum(1 for kk, x in rows if None not in (k, v, x) and kk == k and v * (1 - 0.1) <= x <= v * (1 + 0.1)) for k, v in rows}
    assert got == near
    over_all = similar.similar_counts(df.select("v"), [], "v", 0.1, 20).collect()
    assert {r["v"]: r["similar_rows"] for r in over_all} == {
        v: sum(1 for _, x in rows if None not in (v, x) and v * (1 - 0.1) <= x <= v * (1 + 0.1)) for _, v in rows
    }


def test_similar_to_finds_every_close_row(spark):
    rng = random.Random(17)
    rows = [(i, rng.choice("ab"), rng.choice([None, 0.0, rng.uniform(-20, 20), 10.0, 9.0, 11.2])) for i in range(400)]
    queries = [(j, k, v) for j, (k, v) in enumerate([("a", 10.0), ("b", -5.0), ("a", 0.0), ("b", None), ("a", 1e-3)])]
    df = spark.createDataFrame(rows, "id int, k string, v double")
    asked = spark.createDataFrame(queries, "query_id int, k string, v double")
    got = sorted((r["query_id"], r["id"]) for r in similar.similar_to(df, asked, ["k"], "v").collect())

    def close(a, b):
        if a is None or b is None or a == 0 or b == 0:
            return a == b
        return abs(a - b) / max(abs(a), abs(b)) <= 0.1

    assert got == sorted((j, i) for j, k, v in queries for i, kk, x in rows if k == kk and close(v, x))
    assert spark.range(1).select(within_tolerance(F.lit(None).cast("double"), F.lit(None).cast("double"))).first()[0]


def test_request_metrics_without_success(spark):
    df = spark.createDataFrame([("a", 1, 0, 0.5), ("b", 2, 3, 0.5), ("b", 2, 0, 9.0)], "run_id string, prompt_len int, output_tokens int, latency_s double").withColumn(
        "start_ts", F.timestamp_micros(F.lit(0))
    )
    got = {r["run_id"]: r.asDict() for r in metrics.request_metrics(df).collect()}
    assert got["a"]["valid"] is False and got["a"]["p99_latency_ns"] == 0.0 and got["a"]["total_samples"] == 1 and got["a"]["samples_per_second"] == 0.0
    assert got["b"]["completed"] == 1 and got["b"]["tokens_per_second"] == pytest.approx(5 / 9.0) and got["b"]["p50_latency_ns"] == 5e8
    fixed = {r["run_id"]: r for r in metrics.request_metrics(df, duration=F.lit(2.0)).collect()}
    assert fixed["b"]["samples_per_second"] == 0.5
    assert metrics.request_metrics(df, approx=True).columns == metrics.request_metrics(df).columns
