"""Readers and writers on temporary files."""

import json

import pytest
from pyspark.sql import functions as F

from inferlytics.operators import boards, clean
from inferlytics.plans import pipelines
from inferlytics.sources import readers, tree, writers


def put(path, content):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(content if isinstance(content, str) else json.dumps(content))


@pytest.fixture
def cased(spark):
    spark.conf.set("spark.sql.caseSensitive", "true")
    yield spark
    spark.conf.set("spark.sql.caseSensitive", "false")


def test_result_summaries_to_dashboard(cased, tmp_path):
    common = {"Units": "Tokens/s", "Model": "gptj-99", "number_of_nodes": "2", "accelerators_per_node": "4", "host_processor_model_name": "EPYC"}
    put(tmp_path / "in/a/x-result-summary.json", [{**common, "Result": 10.0, "system.system_name": "S1", "accelerator_model_name": "NVIDIA L4", "debug_uid": "1"}])
    put(tmp_path / "in/b/c/x-result-summary.json", [{**common, "Result": 30.0, "SystemName": "S2", "model": "lower", "framework": "vLLM 0.7", "debug_uid": "2"}, {**common, "Result": 0, "debug_uid": "3"}])
    put(tmp_path / "in/other.json", {"ignored": 1})
    raw = readers.read_result_summaries(cased, str(tmp_path / "in"))
    assert raw.count() == 3 and {"Model", "model"} <= set(raw.columns)
    clean_rows = pipelines.etl(clean.resolve_aliases(raw))
    got = {r["submission.debug_uid"]: r for r in clean_rows.collect()}
    assert sorted(got) == ["1", "2"]
    assert got["1"]["metrics.result_per_accelerator"] == 10.0 / 8 and got["1"]["system.accelerator.vendor"] == "NVIDIA"
    assert got["2"]["software.framework.versions"] == {"vllm": "0.7"} and got["1"]["system.name"] == "S1" and got["2"]["system.name"] is None
    assert clean_rows.columns == sorted(clean_rows.columns)
    put(tmp_path / "prices.json", '{"NVIDIA L4": 0.40, "TPU-v5e": 1.20,\n "a \\"b\\"": 3}')
    prices = readers.read_prices(cased, str(tmp_path / "prices.json"))
    assert {r["name"]: r["price_per_hour"] for r in prices.collect()}["NVIDIA L4"] == 0.4 and prices.count() == 3
    put(tmp_path / "odd.json", '{"Acme \\"X\\" \\u00e9":1.5,"nested":{"inner":7}, "A": 1, "A": 2}')
    odd = {r["name"]: r["price_per_hour"] for r in readers.read_prices(cased, str(tmp_path / "odd.json")).collect()}
    assert odd == {'Acme "X" é': 1.5, "nested": None, "A": 2.0}
    board = pipelines.dashboard(clean_rows, prices)
    assert {r["submission.debug_uid"]: r["system.price_per_hour"] for r in board.collect()} == {"1": pytest.approx(3.2), "2": None}
    assert boards.overview(board).count() == 2
    writers.write_results(clean_rows, str(tmp_path / "out"))
    assert cased.read.parquet(str(tmp_path / "out/parquet")).count() == cased.read.json(str(tmp_path / "out/json")).count() == 2
    for fmt, ending in (("json", ".json.gz"), ("parquet", ".zstd.parquet")):
        files = [f.name for f in (tmp_path / "out" / fmt).glob("part-*")]
        assert files and all(f.endswith(ending) for f in files)


def test_case_insensitive_sessions_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        readers.read_result_summaries(spark, str(tmp_path))


def test_run_directories(spark, tmp_path):
    base = tmp_path / "results"
    put(base / "20250404-153652/performance/benchmark_results.json", {"samples_per_second": 5.5, "mode": None, "scenario": "Server", "rouge1": None})
    put(base / "20250404-153652/accuracy/benchmark_results.json", {"samples_per_second": 1.0, "rouge1": 0.4})
    put(base / "20250404-153652/accuracy/accuracy_results.json", json.dumps({"rouge1": 40.0, "gen_num": 3}, indent=2))
    put(base / "20250405_1/performance/benchmark_results.json", {"samples_per_second": 2.0, "mode": "PerformanceOnly", "datetime": "own"})
    put(base / "20250406-000000/performance/benchmark_results.json", "{ broken")
    put(base / "20250406-000000/accuracy/benchmark_results.json", {"rouge1": 0.1})
    put(base / "20250407-000000/performance/benchmark_results.json", "{}")
    put(base / "notes-1/performance/benchmark_results.json", {"samples_per_second": 9.0})
    put(base / "2025-1/performance/benchmark_results.json", {"samples_per_second": 9.0})
    got = {r["run_id"]: r for r in pipelines.aggregate_runs(spark, str(base)).collect()}
    assert sorted(got) == ["20250404-153652", "20250405_1", "20250406-000000", "20250407-000000"]
    both = got["20250404-153652"]
    assert (both["samples_per_second"], both["rouge1"], both["mode"], both["datetime"]) == (5.5, 0.4, "PerformanceAndAccuracy", "2025-04-04T15:36:52")
    assert both["accuracy_results"]["gen_num"] == 3
    assert (got["20250405_1"]["datetime"], got["20250405_1"]["mode"]) == ("own", "PerformanceOnly")
    assert got["20250406-000000"]["mode"] == "AccuracyOnly" and got["20250407-000000"]["mode"] is None
    published = spark.createDataFrame([("p", 1.0)], "run_id string, price double")
    union = pipelines.aggregate_runs(spark, str(base), published)
    assert {r["source"]: r["count"] for r in union.groupBy("source").count().collect()} == {"published": 1, "local": 4}
    summary = writers.write_runs(pipelines.aggregate_runs(spark, str(base)), str(tmp_path / "runs"))
    assert tuple(summary.first()) == (4, 2, 1)


def test_directories_without_files_are_runs(spark, tmp_path):
    base = tmp_path / "results"
    (base / "20250404-153652").mkdir(parents=True)
    (base / "20250405-000000/performance").mkdir(parents=True)
    (base / "notes").mkdir()
    put(base / "20250406-000000/performance/benchmark_results.json", {"samples_per_second": 2.0})
    got = {r["run_id"]: (r["samples_per_second"], r["mode"], r["datetime"]) for r in pipelines.aggregate_runs(spark, f"file://{base}").collect()}
    assert got == {
        "20250404-153652": (None, None, "2025-04-04T15:36:52"), "20250405-000000": (None, None, "2025-04-05T00:00:00"),
        "20250406-000000": (2.0, "PerformanceOnly", "2025-04-06T00:00:00"),
    }
    *_, listing = readers.read_run_directories(spark, str(base), empty_runs=False)
    assert [r["run_id"] for r in listing.collect()] == ["20250406-000000"]


@pytest.mark.parametrize("partitions", [1, 3, 64])
def test_tree_lists_each_entry_once(spark, tmp_path, partitions):
    rows = [(f"d{i}/e{j}/f{k}.json", f"{i}{j}{k} é") for i in range(4) for j in range(3) for k in range(2)] + [("_hidden.json", "h"), ("d0/.dot", ""), ("empty/deep", None)]
    tree.write_tree(spark.createDataFrame(rows, "path string, text string").repartition(3), str(tmp_path / "t"))
    found = tree.read_tree(spark, str(tmp_path / "t"), "*.json", partitions).collect()
    assert len(found) == len({r["path"] for r in found})
    assert {r["path"]: r["text"] for r in found if not r["is_dir"]} == {p: t if p.endswith("json") else None for p, t in rows if t is not None}
    dirs = {"empty", "empty/deep", *(f"d{i}" for i in range(4)), *(f"d{i}/e{j}" for i in range(4) for j in range(3))}
    assert {r["path"] for r in found if r["is_dir"]} == dirs


def test_stores_that_cannot_be_listed_are_told_early(spark):
    with pytest.raises(ValueError, match="cannot be listed"):
        tree.read_tree(spark, "viewfs://store/x")


def test_run_documents_lose_nothing(spark, tmp_path):
    base = tmp_path / "results"
    put(base / "20250404-153652/performance/benchmark_results.json", {"samples_per_second": 3.0, "gpu": "H100", "model": "m", "none": None})
    put(base / "20250404-153652/accuracy/benchmark_results.json", {"gpu": "late", "note": "n"})
    put(base / "20250404-153652/accuracy/accuracy_results.json", {"rouge1": 44.4, "gen_len": 12.5, "gen_num": 3})
    sweep = {"max_throughput": 8.5, "sweep_results": [{"target_qps": 1.0}], "latest_result": {"a": 1}}
    put(base / "20250405-000000/performance/benchmark_results.json", sweep)
    got = {r["run_id"]: r for r in pipelines.aggregate_runs(spark, str(base)).collect()}
    one = got["20250404-153652"]
    assert one["extra"] == {"gpu": "H100", "model": "m", "note": "n"} and one["samples_per_second"] == 3.0
    results = one["accuracy_results"]
    assert (results["rouge1"], results["gen_len"], results["gen_num"], results["extra"]) == (44.4, None, 3, {"gen_len": "12.5"})
    assert {k: json.loads(v) for k, v in got["20250405-000000"]["extra"].items()} == sweep


def test_published_split_preference(spark, tmp_path):
    one = spark.range(1)
    one.write.parquet(str(tmp_path / "t/validation"))
    spark.range(2).write.parquet(str(tmp_path / "t/test"))
    assert readers.read_published(spark, str(tmp_path / "t")).count() == 2
    assert readers.read_published(spark, str(tmp_path / "t"), "validation").count() == 1
    with pytest.raises(ValueError):
        readers.read_published(spark, str(tmp_path / "t"), "none")
    spark.range(4).write.parquet(str(tmp_path / "flat"))
    assert readers.read_published(spark, str(tmp_path / "flat")).count() == 4


def test_prompts(spark, tmp_path):
    spark.createDataFrame([(0, "q", "a", "s")], "n long, question string, response string, sys string").write.parquet(str(tmp_path / "p"))
    got = readers.read_prompts(spark, str(tmp_path / "p"), "question", "response", "sys", index_col="n").first()
    assert got.asDict() == {"sample_idx": 0, "input": "q", "reference": "a", "system_prompt": "s"}


def test_logs_and_accuracy_log(spark, tmp_path):
    put(tmp_path / "logs/run1/x_summary.txt", "Samples per second: 4.25\nResult is : VALID\n")
    put(tmp_path / "logs/run2/x_summary.txt", "nothing")
    got = {r["run_id"]: r for r in readers.read_run_logs(spark, str(tmp_path / "logs")).collect()}
    assert (got["run1"]["samples_per_second"], got["run1"]["valid"], got["run2"]["samples_per_second"]) == (4.25, True, None)
    put(tmp_path / "acc.json", [{"qsl_idx": 3, "data": "01000000", "seq_id": 9}, {"qsl_idx": 4, "data": ""}])
    assert [tuple(r) for r in readers.read_accuracy_log(spark, str(tmp_path / "acc.json")).collect()] == [(3, "01000000"), (4, "")]


def test_rules(spark, tmp_path):
    put(tmp_path / "base.conf", "# a.b.c = 1\n\n*.*.seed = 15036839855038426416\nllama3_1-405b.Server.tpot_latency = 175\n  *.Server.target_qps = 1.0\nbad line\n")
    put(tmp_path / "user.conf", "*.Server.target_qps = 2.0\n")
    rules = readers.read_rules(spark, str(tmp_path / "base.conf"), str(tmp_path / "user.conf"))
    rows = {(r["layer"], r["model"], r["key"]): (r["value"], r["value_str"]) for r in rules.collect()}
    assert rows == {
        (0, "*", "seed"): (15036839855038426416.0, "15036839855038426416"), (0, "llama3_1-405b", "tpot_latency"): (175.0, "175"),
        (0, "*", "target_qps"): (1.0, "1.0"), (1, "*", "target_qps"): (2.0, "2.0"),
    }


def test_sweeps(spark, tmp_path):
    put(tmp_path / "s/one.json", {"max_throughput": 8.0, "sweep_results": [{"target_qps": 1.0, "samples_per_second": 0.9}, {"qps": 2.0, "error": "no"}], "latest_result": {}})
    put(tmp_path / "s/two.json", {"max_throughput": 3.0, "sweep_results": []})
    rows = readers.read_sweeps(spark, str(tmp_path / "s")).orderBy(F.desc("max_throughput"), "target_qps").collect()
    assert [(r["max_throughput"], r["target_qps"], r["error"]) for r in rows] == [(8.0, 1.0, None), (8.0, 2.0, "no"), (3.0, None, None)]


def test_experiments(spark, tmp_path):
    run = tmp_path / "e/exp1/20250404.153652"
    put(run / "a-input.json", {"input": {"alias": "x", "git": False, "tags": ["main", "_version.5.0", "_url.https://h/a.b", "_branch.", "git"], "version": "5.0"}, "uid": "u"})
    put(run / "step-1/a-input-step.json", {"cmd": "dir", "env": {}, "iso_datetime": "t0", "uid_step": "s"})
    put(run / "step-1/a-result.json", {"iso_datetime": "t1", "uid_step": "s"})
    row = readers.read_experiments(spark, str(tmp_path / "e")).first()
    assert row["tag_values"] == {"version": "5.0", "url": "https://h/a.b", "branch": ""} and row["plain_tags"] == ["git", "main"]
    assert (row["experiment"], row["step"], row["cmd"], row["started"], row["finished"], row["datetime"]) == ("exp1", "step-1", "dir", "t0", "t1", "2025-04-04T15:36:52")
    assert row["meta"] is None
    put(tmp_path / "e/exp1/_cm.json", {"alias": "own", "uid": "m", "tags": ["cmx", "_version.6.0", "imported"]})
    put(tmp_path / "e/exp2/_cm.json", {"uid": "alone"})
    got = {r["experiment"]: r for r in readers.read_experiments(spark, str(tmp_path / "e")).collect()}
    meta = got["exp1"]["meta"]
    assert (meta["alias"], meta["uid"], meta["tag_values"], meta["plain_tags"]) == ("own", "m", {"version": "6.0"}, ["cmx", "imported"])
    assert got["exp2"]["meta"]["uid"] == "alone" and got["exp2"]["stamp"] is None
    assert readers.read_experiments(spark, str(tmp_path / "e"), hidden=False).first()["meta"] is None


def test_write_accuracy(spark, tmp_path):
    writers.write_accuracy(spark.range(3), spark.range(1), str(tmp_path / "a"))
    assert spark.read.json(str(tmp_path / "a/accuracy_details")).count() == 3
    assert spark.read.json(str(tmp_path / "a/accuracy_results")).count() == 1


@pytest.mark.parametrize("formats, mode", [(("json", "parquet"), "errorifexists"), (("json", "parquet"), "append"), (("json", "orc"), "overwrite")])
def test_results_are_worked_out_once_for_all_formats(spark, tmp_path, formats, mode):
    calls = spark.sparkContext.accumulator(0)

    def told(k):
        calls.add(1)
        return f"t{k}"

    made = spark.range(30).select("id", F.udf(told, "string")("id").alias("t"), F.create_map(F.lit("a"), F.col("id")).alias("m"), (F.col("id") % 2).alias("p"))
    df = made.select("p", "id", "t", "m")
    path = str(tmp_path / "out")
    rounds = 2 if mode == "append" else 1
    for _ in range(rounds):
        writers.write_results(df, path, formats, ["p"], mode)
    assert calls.value == 30 * rounds
    for fmt in formats:
        back = spark.read.schema(df.schema).format(fmt).load(f"{path}/{fmt}")
        got = sorted((r["p"], r["id"], r["t"], r["m"]["a"]) for r in back.collect())
        assert got == sorted((k % 2, k, f"t{k}", k) for k in range(30) for _ in range(rounds))


def test_cleaning_keeps_absent_columns_constant(spark):
    """Rules on columns that a table lacks are worked out when planned; a rule searches a text of the table once."""
    raw = spark.createDataFrame([("N/A", 2.0, "Tokens/s", "1", "4", "n/a"), ("PyTorch 2.5.1", 3.0, "Tokens/s", "2", "dummy", "x")],
                                "`software.framework` string, `metrics.result` double, `metrics.units` string, `system.number_of_nodes` string, `system.accelerator.count_per_node` string, `model.name` string")
    out = pipelines.etl(raw)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "null AS datetime" in plan and "null AS system.accelerator.name" in plan
    assert "octet_length(software.framework" not in plan
    assert [(r["software.framework"], r["model.name"], r["system.accelerator.total_count"]) for r in out.collect()] == [(None, None, 4)]
