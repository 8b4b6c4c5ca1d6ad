"""One query per operator, on the bridge views, with plain column names."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hardware as hw
from ..functions.logs import LOG_LABELS, extract_log_metrics
from ..functions.stem import stem_column
from ..functions.text import score_tokens
from ..operators import accuracy as acc
from ..operators import boards, clean, enrich, filters, metrics, prompts, rouge, rules, runs, similar
from ..plans import pipelines
from ..schema import conform, plain_names, qcol
from ..sources import readers
from ..sources.tree import write_tree
from ..sources.writers import write_results
from ..streaming import streams
from ..streaming.storage import shared_folder
from . import bridge

UID = "submission.debug_uid"
ACC = "system.accelerator.name"
COUNTS = ["system.number_of_nodes", "system.accelerator.count_per_node"]
FRAMEWORKS = ["cuda", "pytorch", "vllm"]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def pick(df: DataFrame, *names: str, **aliased: str) -> DataFrame:
    """Columns by canonical name; ``uid`` always stands for the record key."""
    return df.select(*[qcol(n) for n in names], *[qcol(c).alias(n) for n, c in aliased.items()])


def listed(map_col: str) -> Column:
    """A map as text, ``key=value`` by key, so that any number of keys can be compared."""
    return F.array_join(F.array_sort(F.transform(F.map_entries(map_col), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


def raw(spark: SparkSession, sf: str, *need: str) -> DataFrame:
    return bridge.raw_results(spark, sf, {UID, *need})


# --- cleaning -------------------------------------------------------------------------


@query
def aliases_resolved(spark, sf):
    out = clean.resolve_aliases(bridge.raw_records(spark, sf))
    return plain_names(clean.sort_columns(out))


@query
def clean_strings(spark, sf):
    cols = ["submission.division", "system.accelerator.memory_capacity", "model.name", "datetime"]
    out = clean.clean_strings(raw(spark, sf, *cols))
    return pick(out, uid=UID, division=cols[0], memory=cols[1], model=cols[2], stamp=cols[3])


@query
def memory_gb(spark, sf):
    out = clean.normalize_memory(clean.clean_strings(raw(spark, sf, *clean.MEMORY_COLUMNS)))
    return pick(out, uid=UID, accelerator_gb=clean.MEMORY_COLUMNS[0], host_gb=clean.MEMORY_COLUMNS[1])


@query
def frequency_ghz(spark, sf):
    out = clean.normalize_frequency(clean.clean_strings(raw(spark, sf, "system.cpu.frequency")))
    return pick(out, uid=UID, ghz="system.cpu.frequency")


@query
def datetime_iso(spark, sf):
    return pick(clean.normalize_datetime(raw(spark, sf, "datetime")), uid=UID, iso="datetime")


@query
def interconnect(spark, sf):
    out = clean.normalize_interconnect(raw(spark, sf, "system.interconnect.accelerator"), ["system.interconnect.accelerator"])
    return pick(out, uid=UID, family="system.interconnect.accelerator")


@query
def integer_casts(spark, sf):
    out = clean.cast_columns(raw(spark, sf, *COUNTS), {c: "long" for c in COUNTS})
    return pick(out, uid=UID, nodes=COUNTS[0], per_node=COUNTS[1])


@query
def quality_report(spark, sf):
    return clean.quality_report(bridge.raw_results(spark, sf, clean.reported_columns()), bridge.prices(spark, sf))


# --- enrichment -----------------------------------------------------------------------


@query
def accelerator_vendor(spark, sf):
    out = enrich.classify_by_keyword(raw(spark, sf, ACC), ACC, hw.ACCELERATOR_VENDORS, "vendor")
    return pick(out, "vendor", uid=UID)


@query
def cpu_vendor(spark, sf):
    out = enrich.classify_by_keyword(raw(spark, sf, "system.cpu.model"), "system.cpu.model", hw.CPU_VENDORS, "vendor")
    return pick(out, "vendor", uid=UID)


@query
def model_params(spark, sf):
    return pick(enrich.model_parameters(raw(spark, sf, "model.name")), uid=UID, billions="model.number_of_parameters")


@query
def model_arch(spark, sf):
    return pick(enrich.model_architecture(raw(spark, sf, "model.name")), uid=UID, architecture="model.architecture")


@query
def framework_entries(spark, sf):
    out = enrich.framework_versions(raw(spark, sf, "software.framework"))
    return out.select(qcol(UID).alias("uid"), F.posexplode("frameworks").alias("pos", "e")).select(
        "uid", "pos", F.col("e.name").alias("name"), F.col("e.version").alias("version")
    )


@query
def framework_wide(spark, sf):
    out = enrich.framework_map(enrich.framework_wide(raw(spark, sf, "software.framework"), FRAMEWORKS))
    wide = pick(out, uid=UID, versions="software.framework.versions", **{n: f"software.framework.{n}" for n in FRAMEWORKS})
    return wide.withColumn("versions", listed("versions"))


@query
def framework_pivot(spark, sf):
    entries = enrich.framework_versions(raw(spark, sf, "software.framework")).select(
        qcol(UID).alias("uid"), F.posexplode("frameworks").alias("pos", "e")
    ).select("uid", "pos", F.col("e.name").alias("name"), F.col("e.version").alias("version"))
    wide = boards.pivot_first(entries, ["uid"], "name", "version", "pos", FRAMEWORKS, prefix="fw_")
    every = boards.pivot_first(entries, ["uid"], "name", "version", "pos", out="versions")
    return wide.join(every, "uid").withColumn("versions", listed("versions"))


@query
def accuracy_entries(spark, sf):
    out = enrich.parse_accuracy(raw(spark, sf, "metrics.accuracy"))
    return out.select(qcol(UID).alias("uid"), F.explode(qcol("metrics.accuracy.structured")).alias("metric", "value"))


@query
def accuracy_keys(spark, sf):
    return boards.accuracy_keys(raw(spark, sf, "metrics.accuracy"))


def counted(spark, sf, *need) -> DataFrame:
    return clean.cast_columns(raw(spark, sf, *COUNTS, *need), {c: "long" for c in COUNTS})


@query
def total_accelerators_propagate(spark, sf):
    return pick(enrich.total_accelerators(counted(spark, sf)), uid=UID, total="system.accelerator.total_count")


@query
def total_accelerators_one(spark, sf):
    return pick(enrich.total_accelerators(counted(spark, sf), "one"), uid=UID, total="system.total_accelerators")


@query
def per_accelerator(spark, sf):
    out = enrich.result_per_accelerator(enrich.total_accelerators(counted(spark, sf, "metrics.result")))
    return pick(out, uid=UID, per_accelerator="metrics.result_per_accelerator")


@query
def valid_submissions(spark, sf):
    df = enrich.total_accelerators(counted(spark, sf, "metrics.result", "metrics.units"))
    out = filters.valid_submissions(df)
    return pick(out, uid=UID, result="metrics.result", total="system.accelerator.total_count")


@query
def etl_full(spark, sf):
    out = plain_names(pipelines.etl(bridge.raw_results(spark, sf), FRAMEWORKS))
    return out.withColumn("software_framework_versions", listed("software_framework_versions"))


@query
def results_roundtrip(spark, sf):
    """Clean table written as Parquet and JSON lines and read back from the JSON."""
    folder = shared_folder(spark, "results")
    need = ["metrics.result", "metrics.units", *COUNTS, "model.name", ACC, "system.cpu.model", "software.framework"]
    clean_table = plain_names(pipelines.etl(raw(spark, sf, *need)))
    write_results(clean_table, folder)
    back = spark.read.schema(clean_table.schema).json(f"{folder}/json")
    return back.select(
        F.col("submission_debug_uid").alias("uid"), F.col("metrics_result").alias("result"),
        F.col("system_accelerator_vendor").alias("vendor"), F.col("model_architecture").alias("architecture"),
        listed("software_framework_versions").alias("versions"),
    )


# --- prices and costs -----------------------------------------------------------------


def priced(spark, sf, *need) -> DataFrame:
    df = enrich.total_accelerators(counted(spark, sf, ACC, "metrics.result", "metrics.units", *need), "one")
    return enrich.system_price(enrich.with_prices(df, bridge.prices(spark, sf)))


@query
def price_join(spark, sf):
    return pick(priced(spark, sf), uid=UID, unit_price="accelerator.price_per_hour", system_price="system.price_per_hour")


@query
def cost_per_million(spark, sf):
    out = enrich.cost_columns(filters.tokens_only(priced(spark, sf)))
    return pick(
        out, "usd_per_million_tokens", uid=UID, tokens_per_second="result.tokens_per_second",
        cost_per_million="result.cost_per_million_tokens",
    )


@query
def unpriced_accelerators(spark, sf):
    out = enrich.unpriced_accelerators(raw(spark, sf, ACC), bridge.prices(spark, sf))
    return pick(out, "rows", name=ACC)


@query
def price_overrides(spark, sf):
    return enrich.apply_price_overrides(bridge.prices(spark, sf), bridge.price_overrides(spark, sf))


@query
def price_changes(spark, sf):
    return enrich.price_changes(price_overrides(spark, sf))


def dashboard_table(spark, sf, *need) -> DataFrame:
    cols = ["metrics.result", "metrics.units", "metrics.accuracy", ACC, "model.name", "system.name", "submission.scenario", "submission.organization"]
    return pipelines.dashboard(counted(spark, sf, *cols, *need), bridge.prices(spark, sf))


@query
def dashboard(spark, sf):
    out = dashboard_table(spark, sf)
    return out.select(
        qcol(UID).alias("uid"), qcol("system.total_accelerators").alias("total"),
        qcol("system.price_per_hour").alias("system_price"), qcol("result.tokens_per_second").alias("tokens_per_second"),
        qcol("result.cost_per_million_tokens").alias("cost_per_million"),
        F.try_element_at(qcol("metrics.accuracy.structured"), F.lit("rouge1")).alias("rouge1"),
    )


def best_table(spark, sf, keys: list[str]) -> DataFrame:
    cols = ["metrics.result", "metrics.units", ACC, "model.name", "system.name", "submission.scenario", "submission.organization"]
    return pipelines.best_then_price(counted(spark, sf, *cols), bridge.prices(spark, sf), keys)


# --- boards ---------------------------------------------------------------------------


@query
def kpis(spark, sf):
    return boards.kpis(dashboard_table(spark, sf))


@query
def model_counts(spark, sf):
    return pick(boards.value_counts(raw(spark, sf, "model.name"), "model.name"), "count", model="model.name")


@query
def option_lists(spark, sf):
    return pick(boards.distinct_sorted(raw(spark, sf, ACC), ACC), accelerator=ACC)


@query
def overview(spark, sf):
    return plain_names(boards.overview(conform(dashboard_table(spark, sf))))


@query
def performance_view(spark, sf):
    return plain_names(boards.performance_view(best_table(spark, sf, boards.PERFORMANCE_KEYS)))


@query
def top_n_systems(spark, sf):
    df = dashboard_table(spark, sf)
    out = boards.rank_systems(df, ["model.name", "submission.scenario"], n=5)
    return pick(out, "rank", uid=UID, model="model.name", scenario="submission.scenario", tokens_per_second="result.tokens_per_second")


@query
def cost_view(spark, sf):
    return plain_names(boards.cost_view(best_table(spark, sf, boards.COST_KEYS)))


@query
def cost_vs_performance(spark, sf):
    return plain_names(boards.cost_vs_performance_view(best_table(spark, sf, boards.COST_KEYS)))


@query
def pair_compare(spark, sf):
    return boards.compare_systems(boards.best_per_configuration(best_table(spark, sf, boards.CONFIG_KEYS)))


@query
def cost_sensitivity(spark, sf):
    priced = pair_compare(spark, sf).where("price_per_hour_a IS NOT NULL AND price_per_hour_b IS NOT NULL")
    named = priced.agg(F.min("uid_b").alias("uid_b"))
    return boards.cost_sensitivity(priced.join(named, "uid_b", "left_semi"))


@query
def cost_sensitivity_full(spark, sf):
    """The grid of every priced pair; the query above is the excerpt that its SQL covers."""
    return boards.cost_sensitivity(pair_compare(spark, sf))


@query
def select_runs(spark, sf):
    df = dashboard_table(spark, sf)
    out = filters.select_runs(df, "mixtral-8x7b", ["NATION_1", "NATION_3", "NATION_15"], ["TPU-v5e Brand#11", "speedAI Brand#2", "NVIDIA H100 Brand#4"])
    return pick(out, uid=UID, organization="submission.organization", accelerator=ACC)


@query
def systems_for(spark, sf):
    return pick(filters.systems_for(dashboard_table(spark, sf), "TPU-v5e Brand#11", 8), uid=UID, system="system.name")


@query
def similar_configs(spark, sf):
    wanted = {"model.name": "gptj-99", "submission.scenario": "Offline", "metrics.result": 50000.0, "system.type": None}
    df = conform(raw(spark, sf, "model.name", "submission.scenario", "metrics.result"))
    return pick(filters.similar_configurations(df, wanted), uid=UID, result="metrics.result")


@query
def tolerance(spark, sf):
    df = counted(spark, sf, "metrics.result")
    near = filters.within_tolerance(qcol(COUNTS[0]).cast("double"), qcol(COUNTS[1]).cast("double"), 0.4)
    return df.select(qcol(UID).alias("uid"), near.alias("near"))


@query
def similar_counts(spark, sf):
    keys = ["model.name", "submission.scenario", ACC]
    out = similar.similar_counts(raw(spark, sf, "metrics.result", *keys), keys, "metrics.result")
    return pick(out, "rows", "similar_rows", model=keys[0], scenario=keys[1], accelerator=ACC, result="metrics.result")


# --- requests and tokens --------------------------------------------------------------


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Doubles of aggregates rounded, since their last digit depends on the order of rows."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query
def request_metrics(spark, sf):
    return rounded(metrics.request_metrics(bridge.requests(spark, sf)), 3)


@query
def successful_requests(spark, sf):
    return filters.successful_requests(bridge.requests(spark, sf)).select("event_id", "run_id", "output_tokens")


def request_records(spark, sf) -> DataFrame:
    return metrics.request_tokens(bridge.chunks(spark, sf), ["user_id", "day"], carry=["run_id"])


@query
def request_tokens(spark, sf):
    return request_records(spark, sf)


@query
def token_latency(spark, sf):
    return rounded(metrics.token_latency_metrics(request_records(spark, sf), ["run_id"]), 0)


@query
def inter_token(spark, sf):
    gaps = metrics.token_gaps(bridge.chunks(spark, sf), ["user_id", "day"])
    return gaps.select("user_id", "day", "seq", "gap_s", "ttft_s")


@query
def request_fold(spark, sf):
    folded = metrics.inter_token_latency(bridge.chunks(spark, sf), ["user_id", "day"])
    return folded.select(
        "user_id", "day", "ttft_s", "output_tokens", "generated_text", F.size("itl").alias("gaps"),
        F.round(F.aggregate("itl", F.lit(0.0), lambda a, x: a + x), 6).alias("itl_sum"),
    )


@query
def progress(spark, sf):
    ends = bridge.requests(spark, sf).select(
        "run_id", "event_id", (F.unix_micros("start_ts") + F.round(F.col("latency_s") * 1e6).cast("long")).alias("end_us")
    )
    return metrics.progress_marks(ends)


@query
def sweep_plan(spark, sf):
    best = metrics.request_metrics(bridge.requests(spark, sf)).select("run_id", F.round("samples_per_second", 6).alias("max_throughput"))
    return metrics.sweep_plan(best)


@query
def sweep_curve(spark, sf):
    ev = bridge.requests(spark, sf)
    points = ev.groupBy(F.col("run_id").alias("sweep_id"), F.floor(F.col("output_tokens") / 10).alias("step")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg(F.col("latency_s") * 1e9), 0).alias("mean_latency_ns")
    )
    sweeps = points.select(
        "sweep_id", (F.col("step") + 1).cast("double").alias("target_qps"),
        F.when(F.col("step") != 3, F.col("n")).alias("samples_per_second"), "mean_latency_ns",
        F.when(F.col("step") == 3, F.lit("No results found")).alias("error"),
    )
    return metrics.sweep_curve(sweeps)


def run_slo_metrics(spark, sf) -> DataFrame:
    req = metrics.request_metrics(bridge.requests(spark, sf)).select("run_id", "p90_latency_ns", "p99_latency_ns")
    tok = metrics.token_latency_metrics(request_records(spark, sf), ["run_id"]).select(
        "run_id", *[f"{p}_{m}" for p in ["p90", "p99", "p99_9"] for m in ["first_token_latency_ns", "tpot_ns"]]
    )
    return bridge.with_model(req.join(tok, "run_id", "left"))


@query
def rule_resolution(spark, sf):
    return rules.resolve_rules(bridge.with_model(bridge.requests(spark, sf)), bridge.rules(spark))


@query
def slo_report(spark, sf):
    return rounded(rules.slo_report(run_slo_metrics(spark, sf), bridge.rules(spark)), 6)


@query
def config_violations(spark, sf):
    out = filters.validate_run_configs(bridge.run_configs(spark, sf))
    return out.select("config_id", F.size("violations").alias("n"), F.concat_ws(",", "violations").alias("violations"))


@query
def log_metrics(spark, sf):
    out = extract_log_metrics(bridge.log_texts(spark, sf), total=F.col("samples"))
    return out.select("run_id", *LOG_LABELS, "valid", "completed", "total_samples")


@query
def log_metrics_strict(spark, sf):
    return extract_log_metrics(bridge.log_texts(spark, sf), strict=True).select("run_id", *LOG_LABELS)


# --- prompts and accuracy -------------------------------------------------------------


@query
def prompt_render(spark, sf):
    out = prompts.render_prompts(prompts.model_family(bridge.prompts(spark, sf)))
    return out.select("sample_idx", "family", "prompt")


@query
def prompt_fit(spark, sf):
    out = prompts.fit_tokens(bridge.prompts(spark, sf), "input", 24, fixed=True)
    return out.select("sample_idx", "fitted", "n_tokens")


@query
def limited_prompts(spark, sf):
    return prompts.limit_samples(bridge.prompts(spark, sf), 100).select("sample_idx", "conv_id", "turn")


@query
def prompt_batches(spark, sf):
    out = prompts.assign_batches(prompts.limit_samples(bridge.prompts(spark, sf), None), 64)
    return out.select("sample_idx", "conv_id", "turn", "batch_id")


def count_words(frame: pd.DataFrame) -> pd.DataFrame:
    text = frame["input"].fillna("")
    return pd.DataFrame({"sample_idx": frame["sample_idx"], "words": text.str.split(" ").str.len(), "chars": text.str.len()})


@query
def map_batches(spark, sf):
    df = bridge.prompts(spark, sf).select("sample_idx", "input")
    return prompts.map_batches(df, count_words, "sample_idx long, words long, chars long", batch=64)


@query
def hex_decode(spark, sf):
    out = acc.decode_hex_ids(bridge.accuracy_log(spark, sf), vocab_size=bridge.VOCAB_SIZE)
    return out.select("log_id", F.size("token_ids").alias("n"), F.array_join(F.col("token_ids").cast("array<string>"), ",").alias("ids"))


@query
def pair_predictions(spark, sf):
    refs = bridge.prompts(spark, sf).select("sample_idx", "reference")
    return acc.pair_predictions(bridge.accuracy_log(spark, sf).select("log_id", "qsl_idx"), refs)


@query
def decode_tokens(spark, sf):
    ids = acc.decode_hex_ids(bridge.accuracy_log(spark, sf), vocab_size=bridge.VOCAB_SIZE)
    return acc.decode_tokens(ids, bridge.vocabulary(spark, sf), "log_id", sep=" ", vocab_size=bridge.VOCAB_SIZE)


def tokens(spark, sf, stem: bool = False) -> DataFrame:
    return rouge.tokenize_pairs(bridge.prompts(spark, sf), "sample_idx", stem=stem)


@query
def rouge_n(spark, sf):
    return rounded(rouge.rouge_n(tokens(spark, sf), "sample_idx"), 6)


@query
def rouge_n_stemmed(spark, sf):
    return rounded(rouge.rouge_n(tokens(spark, sf, stem=True), "sample_idx"), 6)


@query
def stem_words(spark, sf):
    words = score_tokens(F.col("text"))
    distinct = bridge.table(spark, sf, "conversations").select(F.explode(words).alias("word")).where("word != '\\n'").distinct()
    return stem_column(distinct, "word", "stem")


def lcs_scores(spark, sf) -> DataFrame:
    text = acc.normalize_sentences(bridge.prompts(spark, sf), ["reference", "prediction"])
    return rounded(rouge.rouge_l(rouge.tokenize_pairs(text, "sample_idx"), "sample_idx"), 6)


@query
def rouge_l(spark, sf):
    return lcs_scores(spark, sf).select("sample_idx", "rougeL_precision", "rougeL_recall", "rougeL_f1")


@query
def rouge_lsum(spark, sf):
    return lcs_scores(spark, sf).select("sample_idx", "rougeLsum_precision", "rougeLsum_recall", "rougeLsum_f1")


@query
def sentence_lines(spark, sf):
    return acc.normalize_sentences(bridge.prompts(spark, sf), ["input", "reference"]).select("sample_idx", "input", "reference")


@query
def score_samples(spark, sf):
    pairs = acc.normalize_sentences(bridge.prompts(spark, sf), ["reference", "prediction"])
    return acc.score_samples(pairs, "sample_idx", keep=["reference", "prediction"])


@query
def corpus_accuracy(spark, sf):
    pairs = bridge.prompts(spark, sf).withColumn("n_tokens", F.size(F.split("prediction", " ")))
    return acc.corpus_accuracy(pairs, key="sample_idx", stem=False, lcs=False)


@query
def corpus_accuracy_full(spark, sf):
    pairs = bridge.prompts(spark, sf).withColumn("n_tokens", F.size(F.split("prediction", " ")))
    return acc.corpus_accuracy(pairs, key="sample_idx")


def evaluation(spark, sf, **options) -> tuple[DataFrame, DataFrame]:
    refs = bridge.prompts(spark, sf).select("sample_idx", "system_prompt", "input", "reference")
    return pipelines.accuracy_evaluation(
        bridge.accuracy_log(spark, sf), refs, bridge.vocabulary(spark, sf), bridge.VOCAB_SIZE, sep=" ", **options
    )


@query
def accuracy_evaluation(spark, sf):
    return evaluation(spark, sf, stem=False, lcs=False)[1]


@query
def accuracy_evaluation_full(spark, sf):
    return evaluation(spark, sf)[1]


@query
def accuracy_details(spark, sf):
    return evaluation(spark, sf)[0].select("log_id", "qsl_idx", "prediction", "n_tokens", *acc.SCORES)


# --- runs -----------------------------------------------------------------------------


def merged(spark, sf) -> DataFrame:
    return runs.merge_runs(*bridge.run_halves(spark, sf))


@query
def run_merge(spark, sf):
    return merged(spark, sf).select(
        "run_id", "samples_per_second", "scenario", "rouge1", "mode",
        F.col("accuracy_results.gen_num").alias("gen_num"),
    )


@query
def run_files(spark, sf):
    """Runs from file texts: unknown keys, mistyped numbers and texts that are no JSON among them."""
    files = bridge.run_files(spark, sf)
    out = runs.merge_runs(*readers.run_halves(readers.parse_run_files(files)))
    return out.select(
        "run_id", "samples_per_second", "scenario", "mode", "datetime", "gen_len", F.col("extra.gpu").alias("gpu"),
        F.col("extra.gen_len").alias("gen_len_text"), F.col("extra.max_throughput").try_cast("double").alias("max_throughput"),
        F.col("extra.sweep_results").alias("sweep_results"), F.col("extra.note").alias("note"),
        F.col("accuracy_results.rouge1").alias("rouge1"), F.col("accuracy_results.extra.gen_num").try_cast("double").alias("gen_num"),
    )


@query
def run_directories(spark, sf):
    """Runs of a directory tree that is written and read back: directories without a file count as runs."""
    base = shared_folder(spark, "run-tree")
    write_tree(bridge.run_tree(spark, sf), base)
    return pipelines.aggregate_runs(spark, base).select(
        "run_id", "samples_per_second", "scenario", "rouge1", "mode", "datetime", F.col("accuracy_results.rouge1").alias("result_rouge1")
    )


@query
def experiments(spark, sf):
    """Experiments of a directory tree with their hidden metadata files."""
    base = shared_folder(spark, "experiment-tree")
    write_tree(bridge.experiment_tree(spark, sf), base)
    return readers.read_experiments(spark, base).select(
        "experiment", "step", "cmd", "datetime", F.col("meta.alias").alias("alias"), F.col("meta.uid").alias("meta_uid"),
        F.col("meta.tag_values")["owner"].alias("owner"), F.array_join("meta.plain_tags", ",").alias("meta_tags"),
        F.col("tag_values")["version"].alias("input_version"),
    )


@query
def union_runs(spark, sf):
    out = runs.combine(bridge.published_runs(spark, sf), merged(spark, sf))
    return out.select("source", "run_id", "samples_per_second", "segment", "mode")


@query
def run_summary(spark, sf):
    return runs.run_summary(merged(spark, sf))


@query
def ordered_runs(spark, sf):
    return runs.order_runs(merged(spark, sf), "run_id").select("run_id", "mode")


# --- streams --------------------------------------------------------------------------


def event_stream(spark: SparkSession, sf: str) -> DataFrame:
    """The events file as a stream."""
    schema = bridge.table(spark, sf, "events").schema
    source = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf.rstrip("/"))
    return source.withColumn("ts", F.col("ts").cast("timestamp"))


@query
def stream_metrics(spark, sf):
    ev = event_stream(spark, sf).select(
        F.col("ts").alias("start_ts"), F.col("value").alias("latency_s"), F.length("props").alias("prompt_len"),
        F.when(F.col("event_type") == "error", 0)
        .otherwise(F.regexp_extract("props", r'"k": (\d+)', 1).cast("int")).alias("output_tokens"),
    )
    # The replay reads the file in its own order, so the watermark spans all of it.
    out = streams.replay(spark, streams.stream_request_metrics(ev, watermark="60 days"), "request-metrics", "update")
    return rounded(
        streams.latest(out, ["window_start"])
        .withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd"))
        .drop("window_end"),
        3,
    )


def chunk_stream(spark, sf) -> DataFrame:
    day = F.floor(F.unix_micros("ts") / bridge.DAY_US)
    return event_stream(spark, sf).select(
        "user_id", day.alias("day"), F.col("ts").alias("chunk_ts"), F.timestamp_micros(day * bridge.DAY_US).alias("request_start"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"), F.lit(False).alias("done"),
    )


@query
def stream_tokens(spark, sf):
    """Requests that timers have closed: those whose last chunk lies an hour and ten minutes before the end of the stream."""
    out = streams.replay(spark, streams.stream_token_latency(chunk_stream(spark, sf), ["user_id", "day"]), "token-latency")
    return out.select("user_id", "day", "ttft_s", "latency_s", "output_tokens", "tpot_s", "closed_by")


@query
def stream_token_sessions(spark, sf):
    chunk = chunk_stream(spark, sf)
    keys = ["user_id", "day"]
    # Complete mode, since a replay ends before the watermark passes its last sessions.
    out = streams.replay(spark, streams.stream_token_sessions(chunk, keys, "60 days", "1 day"), "token-sessions", "complete")
    return streams.latest(out, keys)
