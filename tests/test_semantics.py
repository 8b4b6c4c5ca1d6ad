"""Literal rows for every cleaning, classification and filter rule."""

import pytest
from pyspark.sql import functions as F

from inferlytics.functions import hardware as hw
from inferlytics.functions import text as tx
from inferlytics.functions.logs import extract_log_metrics
from inferlytics.operators import boards, clean, enrich, filters, metrics, prompts, runs
from inferlytics.operators.rules import resolve_rules
from inferlytics.schema import conform, feature_catalogue, qcol


def apply(spark, rule, values, kind="string"):
    rows = [(i, v) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i int, v {kind}")
    return [r[1] for r in sorted(df.select("i", rule(F.col("v")).alias("o")).collect())]


def check(spark, rule, cases):
    assert apply(spark, rule, [a for a, _ in cases]) == [b for _, b in cases]


def test_clean_strings(spark):
    check(spark, hw.clean_string, [("n/a", None), ("dummy", None), ("", None), (" ", " "), ("N/A ", "N/A "), ("abc", "abc"), (None, None)])


def test_memory(spark):
    check(
        spark, hw.memory_gb,
        [("1.5 TB", 1536.0), ("64GB + 512 GiB", 576.0), ("80 MB", None), ("HBM 80GB", None), ("80GB (2TB/s)", 81920.0),
         ("0GB + 0GB", None), ("0GB", 0.0), (None, None), ("1.2.3 GB", None), ("2 TiB", 2048.0), ("1GB+x+2GB", 3.0), ("", None)],
    )


def test_frequency(spark):
    check(
        spark, hw.frequency_ghz,
        [("2400", 2.4), ("3800 MHz", 3.8), ("2.0 GHz (3.5GHz turbo)", 3.5), ("Xeon 8480 2.0GHz", 8480.0),
         ("undefined", None), ("", None), (None, None), ("fast", None), (" 2400 ", 2.4)],
    )


def test_datetime(spark):
    check(
        spark, hw.datetime_iso,
        [("2025/04/03_22:56:53", "2025-04-03T22:56:53"), ("2025/04/03 22:56:53", "2025-04-03T22:56:53"),
         ("2025-04-03 22:56:53", "2025-04-03T22:56:53"), ("2025-04-03T22:56:53", "2025-04-03T22:56:53"), ("03-04-2025", None),
         ("N/A", None), ("null", None), ("", None), ("2025/13/03_22:56:53", None), ("2025/04/03_25:00:00", None),
         ("2025-02-30 10:00:00", None), ("2025/04/03_22:56", "2025-04-03T22:56")],
    )


def test_datetime_ignores_the_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # This hour does not exist in that zone.
        check(spark, hw.datetime_iso, [("2025-03-09 02:30:00", "2025-03-09T02:30:00")])
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_interconnect(spark):
    check(
        spark, hw.interconnect,
        [("TODD", None), ("tbd", None), ("NVLink 5th-gen", "NVLink-5"), ("nvlink 4th", "NVLink-4"), ("NVLink", "NVLink"), ("PCIe Gen 5", "PCIe-5"),
         ("PCIe Gen4", "PCIe"), ("Infiniband HDR", "InfiniBand"), ("XGMI", "XGMI"), ("Infinity Fabric", "Infinity Fabric"), (None, None)],
    )


def test_vendors(spark):
    check(
        spark, lambda c: hw.keyword_class(c, hw.ACCELERATOR_VENDORS),
        [("nvidia h100", "NVIDIA"), ("Tesla T4", "NVIDIA"), ("Habana Gaudi2", "Intel"), ("TPU-v5e", "Google"), ("Cloud AI 100", "Qualcomm"),
         ("speedAI240", "UntetherAI"), ("AMD A100", "NVIDIA"), ("Custom", None), (None, None)],
    )
    check(
        spark, lambda c: hw.keyword_class(c, hw.CPU_VENDORS),
        [("EPYC 9654", "AMD"), ("Xeon", "Intel"), ("Grace", "NVIDIA"), ("Neoverse-V2", "ARM"), ("Graviton3", "AWS"), ("M2", "Apple"), ("?", None)],
    )


def test_models(spark):
    check(
        spark, hw.model_parameters,
        [("llama2-70b-99", 70.0), ("LLAMA-3.3-70b-x", 70.0), ("deepseek-v3", 671.0), ("gptj-99", 6.0), ("my gptj", None), ("", None), (None, None)],
    )
    check(spark, hw.model_architecture, [("GPT-J", "LLM"), ("resnet50", "Other"), ("", None), (None, None), ("Falcon", "LLM")])


def test_frameworks(spark):
    df = spark.createDataFrame(
        [(1, "PyTorch 2.5.1, CUDA 12.4"), (2, "TensorRT"), (3, "a 1.0, A 2.0"), (4, None), (5, "vLLM\t0.7.3.,"), (6, "Größe 1.")],
        "id int, `software.framework` string",
    )
    got = {r["id"]: [tuple(e) for e in r["frameworks"] or []] for r in enrich.framework_versions(df).collect()}
    assert got == {
        1: [("pytorch", "2.5.1"), ("cuda", "12.4")], 2: [], 3: [("a", "1.0"), ("a", "2.0")], 4: [],
        5: [("vllm", "0.7.3")], 6: [("größe", "1")],
    }
    wide = enrich.framework_wide(df, ["a", "absent"])
    assert [c for c in wide.columns if c.count(".") == 2] == ["software.framework.a", "software.framework.absent"]
    assert {r["id"]: r["software.framework.a"] for r in wide.collect()}[3] == "1.0"
    assert enrich.framework_wide(df, []).columns == df.columns
    maps = {r["id"]: r["software.framework.versions"] for r in enrich.framework_map(df).collect()}
    assert maps == {1: {"pytorch": "2.5.1", "cuda": "12.4"}, 2: {}, 3: {"a": "1.0"}, 4: None, 5: {"vllm": "0.7.3"}, 6: {"größe": "1"}}


def test_any_number_of_framework_names(spark):
    df = spark.range(1500).select("id", F.format_string("Engine%s 1.%s, CUDA 12", "id", F.col("id") % 7).alias("software.framework"))
    got = {r["id"]: r["software.framework.versions"] for r in enrich.framework_map(df).collect()}
    assert got == {i: {f"engine{i}": f"1.{i % 7}", "cuda": "12"} for i in range(1500)}
    entries = enrich.framework_versions(df).select("id", F.posexplode("frameworks").alias("pos", "e")).select("id", "pos", "e.*")
    assert {r["id"]: r["values"] for r in boards.pivot_first(entries, ["id"], "name", "version", "pos").collect()} == got


def test_aliases(spark):
    df = spark.createDataFrame([("a", None, "x", 1)], "SystemName string, `system.system_name` string, Model string, junk int")
    last = clean.resolve_aliases(df).collect()[0].asDict()
    assert last == {"model.name": "x", "system.name": None}
    assert clean.resolve_aliases(df, mode="coalesce").collect()[0]["system.name"] == "a"
    already = spark.createDataFrame([("kept", "new")], "`model.name` string, Model string")
    assert clean.resolve_aliases(already).collect()[0]["model.name"] == "new"


def test_accuracy_map(spark):
    df = spark.createDataFrame(
        [("ROUGE1: 44.4  ROUGE2: 22.0",), ("a: 1  a: 2",), ("x 5",), (None,), ("bad: y  ok: 3",)], "`metrics.accuracy` string"
    )
    got = [r["metrics.accuracy.structured"] for r in enrich.parse_accuracy(df).collect()]
    assert got == [{"rouge1": 44.4, "rouge2": 22.0}, {"a": 2.0}, {}, None, {"bad": None, "ok": 3.0}]


def test_counts_and_costs(spark):
    df = spark.createDataFrame(
        [(1, 2, 4, 100.0), (2, None, 4, 100.0), (3, 1, 0, 0.0)],
        "id int, `system.number_of_nodes` long, `system.accelerator.count_per_node` long, `metrics.result` double",
    ).withColumn("accelerator.price_per_hour", F.lit(2.0))
    assert [r[-1] for r in enrich.total_accelerators(df).orderBy("id").collect()] == [8, None, 0]
    one = enrich.total_accelerators(df, "one")
    assert [r[-1] for r in one.orderBy("id").collect()] == [8, 4, 0]
    cost = enrich.cost_columns(enrich.system_price(one)).orderBy("id").collect()
    assert cost[0]["result.cost_per_million_tokens"] == 16.0 / 100.0 * 1e6
    assert cost[0]["usd_per_million_tokens"] == pytest.approx(16.0 / 100.0 * 1e6 / 3600)
    assert cost[2]["result.cost_per_million_tokens"] is None
    per = enrich.tokens_per_accelerator(enrich.cost_columns(enrich.system_price(one))).orderBy("id").collect()
    assert [r["result.tokens_per_accelerator"] for r in per] == [12.5, 25.0, 0.0]
    total = enrich.result_per_accelerator(enrich.total_accelerators(df)).orderBy("id").collect()
    assert [r["metrics.result_per_accelerator"] for r in total] == [12.5, None, None]


def test_prices(spark):
    df = spark.createDataFrame([("A",), ("B",), (None,)], "`system.accelerator.name` string")
    prices = spark.createDataFrame([("A", 1.0), ("A", 2.0)], "name string, price_per_hour double")
    assert sorted((r[0] or "", r[1] or 0) for r in enrich.with_prices(df, prices).collect()) == [("", 0), ("A", 2.0), ("B", 0)]
    assert {r[1] for r in enrich.with_prices(df, prices, 1.0).collect()} == {1.0, 2.0}
    assert [tuple(r) for r in enrich.unpriced_accelerators(df, prices).collect()] == [("B", 1)]
    base = spark.createDataFrame([("A", 1.0), ("B", 2.0)], "name string, price_per_hour double")
    over = spark.createDataFrame([("A", 1.0), ("B", 3.0), ("C", 4.0)], "name string, price_per_hour double")
    merged = {r["name"]: (r["price_per_hour"], r["old_price"], r["changed"]) for r in enrich.apply_price_overrides(base, over).collect()}
    assert merged == {"A": (1.0, 1.0, False), "B": (3.0, 2.0, True), "C": (4.0, None, True)}
    same = enrich.apply_price_overrides(base, base.limit(0))
    assert {r["name"]: r["price_per_hour"] for r in same.collect()} == {"A": 1.0, "B": 2.0}
    assert enrich.price_changes(same).count() == 0


def test_filters(spark):
    df = spark.createDataFrame(
        [(1, "Tokens/s", 5.0, 1), (2, "Samples/s", 5.0, 1), (3, "Tokens/s", None, 1), (4, "Tokens/s", 0.0, 1), (5, "Tokens/s", float("inf"), 1),
         (6, "Tokens/s", float("nan"), 1), (7, "Tokens/s", 5.0, 0), (8, "Tokens/s", 5.0, None), (9, None, 5.0, 1), (10, "Tokens/s", float("-inf"), 1)],
        "id int, `metrics.units` string, `metrics.result` double, `system.accelerator.total_count` long",
    )
    assert [r["id"] for r in filters.valid_submissions(df).collect()] == [1]
    assert [r["id"] for r in filters.tokens_only(df).orderBy("id").collect()] == [1, 3, 4, 5, 6, 7, 8, 10]


def test_tolerance(spark):
    df = spark.createDataFrame([(None, None), (0.0, 0.0), (0.0, 1.0), (100.0, 90.0), (100.0, 89.0), (None, 1.0), (-5.0, -5.2)], "a double, b double")
    assert [r[0] for r in df.select(filters.within_tolerance(F.col("a"), F.col("b"))).collect()] == [True, True, False, True, False, False, True]


def test_similar_configurations(spark):
    df = spark.createDataFrame([("m", 9.0), ("m", 11.0), ("m", 12.0), ("n", 10.0), ("m", -10.0)], "`model.name` string, `metrics.result` double")
    got = filters.similar_configurations(df, {"model.name": "m", "metrics.result": 10.0, "system.name": None})
    assert sorted(r[1] for r in got.collect()) == [9.0, 11.0]
    assert filters.similar_configurations(df, {"metrics.result": -10.0}).count() == 0


def test_select_runs_with_lists_and_tables(spark):
    df = spark.createDataFrame(
        [("m", "o1", "a1"), ("m", None, "a1"), ("m", "o2", "a2"), ("n", "o1", "a1")],
        "`model.name` string, `submission.organization` string, `system.accelerator.name` string",
    )
    assert filters.select_runs(df, "m", ["o1", "o2"], ["a1"]).count() == 1
    orgs = spark.createDataFrame([("o1",), ("o2",), ("o1",)], "o string")
    assert filters.select_runs(df, "m", orgs, ["a1", "a2"]).count() == 2


def test_run_config_rules(spark):
    df = spark.createDataFrame(
        [(1, "Offline", False, None, None, "performance", None), (2, "Server", True, 1.0, 8, "all", "y"), (3, "SingleStream", False, None, None, "accuracy", ""),
         (4, "SingleStream", False, None, None, "performance", None), (5, "Offline", None, 2.0, 4, "accuracy", "y")],
        "id int, scenario string, sweep boolean, target_qps double, batch_size int, mode string, output_column string",
    )
    got = {r["id"]: r["violations"] for r in filters.validate_run_configs(df).collect()}
    assert got == {
        1: ["rate_or_sweep_required"], 2: ["server_without_batch_size", "sweep_without_accuracy"],
        3: ["output_column_required", "single_stream_without_accuracy"], 4: [], 5: [],
    }
    paths = df.withColumn("remote_model_path", F.lit(None).cast("string")).withColumn("model_path", F.lit("p"))
    assert filters.validate_run_configs(paths).first()["remote_model_path"] == "p"


def test_log_metrics(spark):
    text = (
        "Completed samples per second    : 12.5\nTokens per second: 99.\nMean latency (ns) : 1.2e+06\nResult is : INVALID\n"
        "99.90 percentile first token latency (ns) : 77\nEarly stopping satisfied"
    )
    df = spark.createDataFrame([(text,), ("Result is : VALID",)], "text string")
    bad, good = extract_log_metrics(df, total=F.lit(10)).collect()
    assert (bad["samples_per_second"], bad["tokens_per_second"], bad["mean_latency_ns"]) == (12.5, 99.0, 1.2)
    assert (bad["p99_9_first_token_latency_ns"], bad["p50_tpot_ns"], bad["valid"], bad["completed"]) == (77.0, None, False, 10)
    assert (good["valid"], good["completed"], good["total_samples"]) == (True, 0, 10)
    assert extract_log_metrics(df, strict=True).first()["mean_latency_ns"] == 1200000.0


def test_model_family_and_prompts(spark):
    check(
        spark, tx.model_family,
        [("meta/Llama2-7b", "llama2"), ("x/llama3-8b", "llama3"), ("Llama-3.2-1B", "smollm"), ("DeepSeek-R1-Distill-Llama-8B", "deepseek"), ("other", "smollm")],
    )
    df = spark.createDataFrame([("  hi  ", None, "deepseek"), ("q", " s", "llama2"), ("q", "s", "smollm")], "input string, system_prompt string, family string")
    assert [r["prompt"] for r in prompts.render_prompts(df).collect()] == [
        "hi", "<s>[INST] <<SYS>>\n s\n<</SYS>>\n\nq [/INST]", "s\n\nHuman: q\n\nAssistant:"
    ]
    assert prompts.render_prompts(df, null_as="None").first()["prompt"] == "None\n\n  hi"
    default = prompts.render_prompts(df, F.lit("llama3"), system_col=None).first()["prompt"]
    assert default.startswith("<|begin_of_text|>") and "You are an AI assistant.<|eot_id|>" in default and default.endswith("<|end_header_id|>")


def test_fit_tokens_and_batches(spark):
    df = spark.createDataFrame([(0, " a b  c "), (1, "a b c d e"), (2, "")], "sample_idx long, t string")
    assert [r["fitted"] for r in prompts.fit_tokens(df, "t", 4, fixed=True, pad="#").orderBy("sample_idx").collect()] == ["a b c #", "a b c d", "# # # #"]
    assert [r["fitted"] for r in prompts.fit_tokens(df, "t", 4).orderBy("sample_idx").collect()] == ["a b c", "a b c d", ""]
    own = prompts.fit_tokens(df, "t", 2, tokenizer=_first_two)
    assert [r["fitted"] for r in own.orderBy("sample_idx").collect()] == [" a", "a ", ""]
    assert [r["batch_id"] for r in prompts.assign_batches(df, 2).orderBy("sample_idx").collect()] == [0, 0, 1]
    assert {r["batch_id"] for r in prompts.assign_batches(df, None).collect()} == {0}
    assert prompts.limit_samples(df, 2).count() == 2 and prompts.limit_samples(df, None).count() == 3


def _first_two(texts):
    return texts.str[:2]


def test_sweeps(spark):
    plan = metrics.sweep_plan(spark.createDataFrame([(10.0,), (0.0,), (None,)], "max_throughput double"), 10)
    rates = [r["target_qps"] for r in plan.where("max_throughput = 10").orderBy("point").collect()]
    assert rates == [1.2, 2.4, 3.6, 4.8, 6.0, 7.2, 8.4, 9.6, 10.8, 12.0]
    assert plan.where("max_throughput = 500").count() == 20
    points = spark.createDataFrame([("s", 1.0, 5.0, None), ("s", 2.0, 10.0, None), ("s", 3.0, None, "failed")], "sweep_id string, target_qps double, samples_per_second double, error string")
    assert [(r["failed"], r["fraction_of_max"]) for r in metrics.sweep_curve(points).collect()] == [(False, 0.5), (False, 1.0), (True, None)]


def test_rule_precedence(spark):
    rules = spark.createDataFrame(
        [("*", "*", "k", 1.0, 0), ("*", "Server", "k", 2.0, 0), ("m", "*", "k", 3.0, 0), ("m", "Server", "k", 4.0, 0), ("*", "*", "u", 5.0, 1), ("m", "Server", "u", 6.0, 0)],
        "model string, scenario string, key string, value double, layer int",
    )
    runs_ = spark.createDataFrame([("m", "Server"), ("m", "Offline"), ("x", "Server"), ("x", "Offline"), ("m", "Server")], "model string, scenario string")
    got = {(r["model"], r["scenario"], r["key"]): r["value"] for r in resolve_rules(runs_, rules).collect()}
    assert got == {
        ("m", "Server", "k"): 4.0, ("m", "Offline", "k"): 3.0, ("x", "Server", "k"): 2.0, ("x", "Offline", "k"): 1.0,
        ("m", "Server", "u"): 5.0, ("m", "Offline", "u"): 5.0, ("x", "Server", "u"): 5.0, ("x", "Offline", "u"): 5.0,
    }


def test_merge_runs(spark):
    perf = spark.createDataFrame([("a", 1.0, None, "PerformanceOnly"), ("b", None, 5, None)], "run_id string, samples_per_second double, completed long, mode string")
    acc = spark.createDataFrame([("a", 9.0, 7, 0.5), ("c", 3.0, None, 0.6)], "run_id string, samples_per_second double, completed long, rouge1 double")
    res = spark.createDataFrame([("b", 1.0), ("d", 2.0)], "run_id string, rouge1 double")
    listing = spark.createDataFrame([(k, "t") for k in "abcde"], "run_id string, datetime string")
    got = {r["run_id"]: r for r in runs.merge_runs(perf, acc, res, listing).collect()}
    assert (got["a"]["samples_per_second"], got["a"]["completed"], got["a"]["rouge1"], got["a"]["mode"]) == (1.0, 7, 0.5, "PerformanceAndAccuracy")
    assert got["b"]["mode"] == "PerformanceAndAccuracy" and got["b"]["accuracy_results"]["rouge1"] == 1.0
    assert (got["c"]["mode"], got["d"]["mode"], got["e"]["mode"], got["e"]["datetime"]) == ("AccuracyOnly", "AccuracyOnly", None, "t")
    assert got["c"]["accuracy_results"] is None
    summary = runs.run_summary(runs.merge_runs(perf, acc, res, listing)).first()
    assert tuple(summary) == (5, 2, 2)


def test_best_rows_equal_rank_one_and_nulls_lose(spark):
    df = spark.createDataFrame(
        [("g", 1.0, "u1"), ("g", 3.0, "u2"), ("g", 3.0, "u3"), ("g", None, "u9"), ("h", None, "u4"), (None, 2.0, "u5")],
        "`system.name` string, `result.tokens_per_second` double, `submission.debug_uid` string",
    )
    best = {r["submission.debug_uid"] for r in boards.best_per_group(df, ["system.name"]).collect()}
    first = {r["submission.debug_uid"] for r in boards.rank_systems(df, ["system.name"], n=1).collect()}
    assert best == first == {"u3", "u4", "u5"}
    assert boards.best_per_group(df.repartition(7), ["system.name"]).count() == 3


def test_pricing_after_the_choice_gives_the_same_boards(spark):
    from inferlytics.catalog import bridge
    from inferlytics.operators.boards import COST_KEYS, PERFORMANCE_KEYS
    from inferlytics.plans import pipelines

    sf = "/root/testdata/sf0.001"
    df = clean.cast_columns(bridge.raw_results(spark, sf), {c: "long" for c in ["system.number_of_nodes", "system.accelerator.count_per_node"]})
    prices = bridge.prices(spark, sf)
    whole = pipelines.dashboard(df, prices)
    for view, keys in ((boards.cost_view, COST_KEYS), (boards.performance_view, PERFORMANCE_KEYS)):
        a, b = view(whole), view(pipelines.best_then_price(df, prices, keys))
        assert a.columns == b.columns and sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_kpis_count_null_as_a_value(spark):
    df = spark.createDataFrame(
        [("s", None, "a", 2), ("s", "o", "a", None)],
        "`system.name` string, `submission.organization` string, `system.accelerator.name` string, `system.total_accelerators` long",
    )
    assert tuple(boards.kpis(df).first()) == (1, 2, 1, 2, 2)
    assert tuple(boards.kpis(df, approx=True).first()) == (1, 2, 1, 2, 2)


def test_named_pairs_and_grid(spark):
    best = spark.createDataFrame(
        [("m", "A", 2, "sa", "o", 10.0, 6.0, "ua"), ("m", "B", 4, "sb", "o", 20.0, 9.0, "ub"), ("m", "C", 1, "sc", "o", 5.0, None, "uc")],
        "`model.name` string, `system.accelerator.name` string, `system.total_accelerators` long, `system.name` string, "
        "`submission.organization` string, `result.tokens_per_second` double, `system.price_per_hour` double, `submission.debug_uid` string",
    )
    named = spark.createDataFrame([("m", "A", 2, "B", 4), ("m", "A", 2, "A", 2)], "model string, accelerator_a string, count_a long, accelerator_b string, count_b long")
    pair = boards.compare_systems(best, named).collect()
    assert len(pair) == 1
    p = pair[0]
    assert (p["perf_delta"], p["perf_delta_pct"], p["cost_a"], p["cost_b"], p["cost_delta"], p["cost_delta_pct"]) == (10.0, 100.0, 1.0, 3.0, 2.0, 200.0)
    auto = {(r["uid_a"], r["uid_b"]) for r in boards.compare_systems(best).collect()}
    assert auto == {("ub", "ua"), ("ub", "uc")}
    grid = boards.cost_sensitivity(boards.compare_systems(best, named), points=3).orderBy("ix", "iy").collect()
    assert len(grid) == 9
    assert [g["price_per_hour"] for g in grid[::3]] == [0.0, 5.625, 11.25] and grid[2]["tokens_per_second"] == 25.0
    assert grid[0]["cost_delta"] == -1.0 and grid[0]["cost_delta_pct_of_cost"] == -100.0
    assert grid[0]["cost_delta_pct_of_price"] == pytest.approx(-1.0 / 6 * 100)
    assert grid[0]["max_abs_cost_delta"] == max(abs(g["cost_delta"]) for g in grid)
    assert boards.cost_sensitivity(boards.compare_systems(best, named)).count() == 10_000


def test_full_grid_covers_every_priced_pair(spark):
    from inferlytics.catalog.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    names = ["price_per_hour_a", "price_per_hour_b", "tokens_per_second_a", "tokens_per_second_b"]
    pairs = [r for r in QUERIES["pair_compare"](spark, sf).collect() if r[names[0]] is not None and r[names[1]] is not None]
    grid = QUERIES["cost_sensitivity_full"](spark, sf)
    cells = grid.groupBy("model", "uid_a", "uid_b").agg(
        F.count("*").alias("n"), F.countDistinct("ix", "iy").alias("places"), F.max("price_per_hour").alias("x"), F.max("tokens_per_second").alias("y"),
        F.max("max_abs_cost_delta").alias("most"), F.max(F.abs("cost_delta")).alias("found"),
    )
    got = {(r["model"], r["uid_a"], r["uid_b"]): r for r in cells.collect()}
    assert set(got) == {(p["model"], p["uid_a"], p["uid_b"]) for p in pairs} and len(pairs) > 100
    for p in pairs:
        r = got[p["model"], p["uid_a"], p["uid_b"]]
        assert r["n"] == r["places"] == 10_000
        top_y = [v for v in (p[names[2]], p[names[3]]) if v is not None]
        assert r["x"] == max(p[names[0]], p[names[1]]) * 1.25 and r["y"] == (max(top_y) * 1.25 if top_y else None)
        if r["most"] is not None:
            assert r["found"] == pytest.approx(r["most"])


def test_pivot_first(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (1, "a", "y", 0), (1, "b", "z", 0)], "k int, n string, v string, p int")
    assert boards.pivot_first(df, ["k"], "n", "v", "p", ["a", "b"], prefix="c.").collect()[0].asDict() == {"k": 1, "c.a": "y", "c.b": "z"}
    assert boards.pivot_first(df, ["k"], "n", "v", "p").collect()[0].asDict() == {"k": 1, "values": {"a": "y", "b": "z"}}


def test_schema_helpers(spark):
    df = spark.createDataFrame([("x",)], "`model.name` string")
    full = conform(df)
    assert full.schema["metrics.result"].dataType.simpleString() == "double" and full.select(qcol("model.name")).first()[0] == "x"
    kinds = {r["column"]: r["kind"] for r in feature_catalogue(full).collect()}
    assert kinds["metrics.result"] == "continuous" and kinds["submission.availability"] == "boolean" and kinds["metrics.units"] == "categorical"


def test_strict_cast_fails(spark):
    df = spark.createDataFrame([("2x",)], "v string")
    assert clean.cast_columns(df, {"v": "long"}).first()["v"] is None
    with pytest.raises(Exception):
        clean.cast_columns(df, {"v": "long"}, strict=True).collect()


def test_prices_join_the_same_with_any_list_size(spark):
    rows = [(k, [None, "a", "b", "c d"][k % 4]) for k in range(50)]
    df = spark.createDataFrame(rows, "uid long, name string").select("uid", F.col("name").alias("system.accelerator.name"))
    prices = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("c d", 3.0)], "name string, price_per_hour double")
    one, other = enrich.with_prices(df, prices), enrich.with_prices(df, prices, small=1)
    assert one.columns == other.columns and sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    assert "BroadcastHashJoin" in one._jdf.queryExecution().toString()
    assert {r["accelerator.price_per_hour"] for r in one.collect()} == {None, 2.0, 3.0}
