"""Views that give the star-schema test tables the shape of the library's inputs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranks import ordered_index, settled

DAY_US = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fact_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    """Needed columns of a large table."""
    return table(spark, sf_dir, name).select(*cols)


def choose(index: Column, values: list) -> Column:
    """Value by number; a string names itself, None is null, a column is used as it is."""
    case = F
    for i, v in enumerate(values):
        case = case.when(index == i, v if isinstance(v, Column) else F.lit(v))
    return case.otherwise(F.lit(None))


def raw_results(spark: SparkSession, sf_dir: str, need: set[str] | list[str] | None = None) -> DataFrame:
    """Raw result table (canonical names, text values) made of lineitem and its dimensions.

    ``need`` limits the columns. The dimensions are joined from the left on their unique
    keys, so leaving out an unneeded one changes no row.
    """
    line = fact_table(
        spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus",
    )
    c = F.col
    n, pk, sk = c("l_linenumber"), c("l_partkey"), c("l_suppkey")
    size, quantity = c("p_size"), c("l_quantity").cast("int")
    text = "string"
    # Names without end: each supplier has an engine of its own.
    engine = F.concat(F.lit("TensorRT 10."), n.cast(text), F.lit(", Engine"), sk.cast(text), F.lit(" 1."), (pk % 9).cast(text))
    engine = F.when(sk % 3 == 0, F.lit("TensorRT")).otherwise(engine)
    columns = {
        "submission.debug_uid": ("", F.concat_ws("-", "l_orderkey", n, pk, sk, quantity)),
        "submission.organization": ("sn", c("n_name")),
        "submission.division": ("", F.when(c("l_returnflag") == "A", "closed").when(c("l_returnflag") == "N", "open").when(c("l_returnflag") == "R", "N/A")),
        "submission.availability": ("o", c("o_orderstatus")),
        "submission.scenario": ("", F.when(c("l_linestatus") == "F", "Offline").when(c("l_linestatus") == "O", "Server")),
        "system.name": ("s", c("s_name")),
        "metrics.units": ("", F.when(n == 7, "Samples/s").otherwise("Tokens/s")),
        "metrics.result": ("", F.when(c("l_quantity") == 50, None).when(c("l_quantity") == 49, 0.0).otherwise(c("l_extendedprice"))),
        "metrics.accuracy": ("", F.when(n != 6, F.concat(F.lit("ROUGE1: "), quantity.cast(text), F.lit("  ROUGE2: "), n.cast(text)))),
        "model.name": ("", choose(pk % 7, ["llama2-70b-99", "gptj-99", "mixtral-8x7b", "DeepSeek-R1-Distill-Llama-8B", "resnet50", "", "Llama3_1-405B"])),
        "system.accelerator.name": ("p", F.concat(choose(size % 8, ["NVIDIA H100 ", "AMD Instinct ", "Intel Gaudi2 ", "TPU-v5e ", "Qualcomm Cloud AI 100 ", "speedAI ", "Custom ", None]), c("p_brand"))),
        "system.number_of_nodes": ("p", F.when(size % 10 != 0, (1 + n % 4).cast(text))),
        "system.accelerator.count_per_node": ("p", F.when(size % 13 == 0, "0").when(size % 17 == 0, "2x").otherwise((1 + size % 8).cast(text))),
        "system.accelerator.memory_capacity": ("p", choose(n % 6, ["80 GB", "1.5 TB", F.concat(size.cast(text), F.lit(" GiB + 64GB")), "N/A", "512MB", "0GB + 0GB"])),
        "system.memory.capacity": ("p", choose(pk % 4, ["2 TiB", F.concat(size.cast(text), F.lit(" GB")), None, "HBM 80GB"])),
        "system.cpu.model": ("", choose(sk % 6, ["AMD EPYC 9654", "Intel Xeon 8480", "NVIDIA Grace", "Neoverse-V2", "Apple M2", "Unknown"])),
        "system.cpu.frequency": ("", choose(sk % 5, ["2.0 GHz (3.5GHz turbo)", "2400", "3800 MHz", "undefined", ""])),
        "system.interconnect.accelerator": ("", choose(n % 7, ["NVLink 5th-gen", "nvlink 4th", "NVLink", "PCIe Gen5 x16", "PCIe", "TBD", "Infinity Fabric"])),
        "software.framework": ("", choose(n % 4, ["PyTorch 2.5.1, CUDA 12.4", "vLLM 0.7.3", engine, None])),
        "datetime": ("", choose(n % 3, ["2025/04/03_22:56:53", "2025-04-03 22:56:53", "N/A"])),
    }
    wanted = [k for k in columns if need is None or k in need]
    sides = "".join(columns[k][0] for k in wanted)
    if "p" in sides:
        line = line.join(table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_brand"), pk == c("p_partkey"), "left")
    if "s" in sides:
        line = line.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey"), sk == c("s_suppkey"), "left")
    if "n" in sides:
        line = line.join(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), c("s_nationkey") == c("n_nationkey"), "left")
    if "o" in sides:
        line = line.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus"), c("l_orderkey") == c("o_orderkey"), "left")
    return line.select(*[columns[k][1].alias(k) for k in wanted])


def raw_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same results under raw keys, before aliases are resolved."""
    names = {
        "submission.debug_uid": "debug_uid",
        "submission.organization": "Organization",
        "submission.scenario": "Scenario",
        "metrics.result": "Result",
        "metrics.units": "Units",
        "model.name": "Model",
        "system.name": "system.system_name",
        "system.number_of_nodes": "number_of_nodes",
    }
    raw = raw_results(spark, sf_dir, [*names, "system.cpu.model", "system.accelerator.name"])
    return raw.select(
        *[F.col(f"`{c}`").alias(n) for c, n in names.items()],
        # Two aliases of one column: the prefixed one wins as a whole, nulls included.
        F.col("`system.cpu.model`").alias("host_processor_model_name"),
        F.col("`system.accelerator.name`").alias("system.host_processor_model_name"),
        F.col("`system.name`").alias("unknown_key"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = raw_results(spark, sf_dir, ["system.accelerator.name"]).select(F.col("`system.accelerator.name`").alias("name"))
    return (
        names.where(F.col("name").isNotNull() & ~F.col("name").endswith("5"))
        .distinct()
        .withColumn("price_per_hour", F.round(F.length("name") * 0.1, 2))
    )


def price_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = spark.range(1).select(F.lit("Override Only").alias("name"))
    return (
        prices(spark, sf_dir).where(F.col("name").endswith("1")).select("name").union(new)
        .withColumn("price_per_hour", F.lit(9.99))
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with a zoned timestamp and the number ``k`` of their properties."""
    cols = ["event_id", "ts", "user_id", "event_type", "value", "props"]
    return fact_table(spark, sf_dir, "events", *cols).select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        "user_id",
        "event_type",
        "value",
        "props",
        F.regexp_extract("props", r'"k": (\d+)', 1).cast("int").alias("k"),
    )


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).select(
        "event_id",
        F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        F.col("ts").alias("start_ts"),
        F.col("value").alias("latency_s"),
        F.when(F.col("event_type") == "error", 0).otherwise(F.col("k")).alias("output_tokens"),
        F.length("props").alias("prompt_len"),
        F.lit(1).alias("batch_size"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.floor(F.unix_micros("ts") / DAY_US)
    return events(spark, sf_dir).select(
        "user_id",
        day.alias("day"),
        F.concat(F.lit("run"), (F.col("user_id") % 5).cast("string")).alias("run_id"),
        F.timestamp_micros(day * DAY_US).alias("request_start"),
        F.col("ts").alias("chunk_ts"),
        F.col("event_id").alias("seq"),
        F.when(F.col("event_type") == "error", "").otherwise(F.col("event_type")).alias("text"),
    )


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    talk = table(spark, sf_dir, "conversations")
    user = talk.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("input"))
    answer = talk.where(F.col("role") == "assistant").select(
        F.col("conv_id").alias("_c"), (F.col("turn") - 1).alias("_t"), F.col("text").alias("reference")
    )
    system = (
        talk.where(F.col("role") == "system")
        .groupBy(F.col("conv_id").alias("_s"))
        .agg(F.min_by("text", "turn").alias("system_prompt"))
    )
    pairs = user.join(answer, (F.col("conv_id") == F.col("_c")) & (F.col("turn") == F.col("_t"))).drop("_c", "_t")
    paths = ["meta-llama/llama2-7b", "meta/llama3-8b", "meta-llama/Llama-3.2-1B", "DeepSeek-R1", "other"]
    return (
        ordered_index(pairs, "conv_id", "turn")
        .join(system, F.col("conv_id") == F.col("_s"), "left")
        .select(
            "sample_idx", "conv_id", "turn", "input", "reference", "system_prompt",
            choose(F.col("conv_id") % 5, paths).alias("model_path"),
            F.col("input").alias("prediction"),
        )
    )


def accuracy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(log_id, qsl_idx, data): ids of one user and day, in time order, as hex text."""
    word = F.concat(F.lpad(F.lower(F.hex("k")), 2, "0"), F.lit("000000"))
    hour = F.floor(F.unix_micros("ts") / 3_600_000_000)
    ev = events(spark, sf_dir).select("user_id", hour.alias("hour"), "ts", "event_id", word.alias("w"))

    def in_order(items: str, field: str) -> Column:
        return F.concat_ws("", F.transform(items, lambda x: x[field]))

    hourly = (
        ev.groupBy("user_id", "hour")
        .agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "w"))).alias("x"))
        .select("user_id", F.floor(F.col("hour") / 24).alias("day"), "hour", in_order("x", "w").alias("w"))
    )
    daily = (
        hourly.groupBy("user_id", "day")
        .agg(F.sort_array(F.collect_list(F.struct("hour", "w"))).alias("x"))
        .select("user_id", "day", in_order("x", "w").alias("data"))
    )
    # the index looks at its rows several times, so the logs are put together once
    rows = ordered_index(settled(daily, "daily-logs"), "user_id", "day", out="n").select(
        F.concat_ws("-", "user_id", "day").alias("log_id"), (F.col("n") % 300).alias("qsl_idx"), "data"
    )
    outside = spark.range(1).select(F.lit("outside").alias("log_id"), F.lit(-1).cast("long").alias("qsl_idx"), F.lit("01000000").alias("data"))
    return rows.union(outside)


VOCAB_SIZE = 90


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids that occur in the events, with their pieces."""
    ids = events(spark, sf_dir).select(F.col("k").alias("token_id")).distinct()
    return ids.select(
        "token_id", F.concat(F.lit("t"), F.col("token_id").cast("string")).alias("piece"), (F.col("token_id") % 25 == 0).alias("special")
    )


def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    return table(spark, sf_dir, "orders").select(
        key.alias("config_id"),
        choose(cust % 3, ["Offline", "Server", "SingleStream"]).alias("scenario"),
        (key % 4 == 0).alias("sweep"),
        F.when(key % 5 >= 2, F.lit(1.0)).alias("target_qps"),
        F.when(key % 7 == 0, F.lit(8)).alias("batch_size"),
        choose(key % 3, ["performance", "accuracy", "all"]).alias("mode"),
        F.when(key % 11 != 0, F.lit("response")).alias("output_column"),
    )


def with_model(df: DataFrame) -> DataFrame:
    """Model and scenario of each run of the request views."""
    models = ["llama2-70b", "llama2-70b-interactive", "mixtral-8x7b", "llama3_1-405b", "gptj"]
    number = F.substring("run_id", 4, 1).cast("int")
    return df.withColumn("model", choose(number, models)).withColumn("scenario", F.lit("Server"))


# --- fixed values: server rules as (model, scenario, key, value) ---------------------
SERVER_RULES = """\
*.Server.target_latency = 10
*.Server.target_latency_percentile = 99
gptj.Server.target_latency = 20000
llama2-70b.Server.target_latency = 0
llama2-70b.Server.ttft_latency = 2000
llama2-70b.Server.tpot_latency = 200
llama2-70b-interactive.Server.target_latency = 0
llama2-70b-interactive.Server.ttft_latency = 450
llama2-70b-interactive.Server.tpot_latency = 40
mixtral-8x7b.Server.target_latency = 0
mixtral-8x7b.Server.ttft_latency = 2000
mixtral-8x7b.Server.tpot_latency = 200
llama3_1-405b.Server.target_latency = 0
llama3_1-405b.Server.ttft_latency = 6000
llama3_1-405b.Server.tpot_latency = 175
"""
USER_RULES = """\
*.Server.target_qps = 1.0
*.Server.min_duration = 1
"""
# --- end of fixed values -------------------------------------------------------------


def rules(spark: SparkSession) -> DataFrame:
    from ..sources.readers import parse_rules

    def lines(text: str) -> DataFrame:
        return spark.range(1).select(F.explode(F.split(F.lit(text), "\n")).alias("value"))

    return parse_rules(lines(SERVER_RULES)).unionByName(parse_rules(lines(USER_RULES), 1))


def run_halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Performance half, accuracy half and accuracy results of one run per order."""
    orders = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    run = key.cast("string").alias("run_id")
    perf = orders.where(key % 3 != 0).select(
        run,
        F.when(key % 10 != 1, F.col("o_totalprice")).alias("samples_per_second"),
        F.when(key % 4 == 0, F.lit("PerformanceOnly")).alias("mode"),
        F.col("o_orderstatus").alias("scenario"),
    )
    acc = orders.where(key % 2 == 0).select(
        run,
        (F.col("o_totalprice") / 2).alias("samples_per_second"),
        F.lit(None).cast("string").alias("mode"),
        F.lit("Offline").alias("scenario"),
        (key % 100).cast("double").alias("rouge1"),
    )
    results = orders.where(key % 4 == 0).select(run, (key % 100).cast("double").alias("rouge1"), (key % 7).alias("gen_num"))
    return perf, acc, results


def run_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text): files of one run directory per order, some with sweeps, own keys, odd numbers or broken text."""
    orders = table(spark, sf_dir, "orders")
    key, total = F.col("o_orderkey"), F.col("o_totalprice")
    place = F.concat(F.lit("/runs/"), F.lpad(key.cast("string"), 10, "0"), F.lit("-1/"))
    sweep = F.array(F.struct(key.alias("target_qps")))
    perf = F.to_json(
        F.struct(
            F.when(key % 10 != 1, total).alias("samples_per_second"),
            F.col("o_orderstatus").alias("scenario"),
            F.col("o_orderpriority").alias("gpu"),
            F.concat(key.cast("string"), F.when(key % 5 == 0, ".5").otherwise("")).alias("gen_len"),
            F.when(key % 7 == 0, total * 2).alias("max_throughput"),
            F.when(key % 7 == 0, sweep).alias("sweep_results"),
        )
    )
    acc = F.to_json(F.struct((total / 2).alias("samples_per_second"), F.lit("Offline").alias("scenario"), F.lit("acc").alias("gpu"), F.lit("n").alias("note")))
    results = F.to_json(F.struct((key % 100).cast("double").alias("rouge1"), (key % 9 + 0.5).alias("gen_num")))
    files = [
        (key % 3 != 0, "performance/benchmark_results.json", F.when(key % 11 == 0, F.lit("{ broken")).otherwise(perf)),
        (key % 2 == 0, "accuracy/benchmark_results.json", F.when(key % 13 == 0, F.lit("[1]")).otherwise(acc)),
        (key % 4 == 0, "accuracy/accuracy_results.json", F.when(key % 17 == 0, F.lit(" {} ")).otherwise(results)),
    ]
    some = F.array_compact(F.array(*[F.when(has, F.struct(F.concat(place, F.lit(name)).alias("path"), text.alias("text"))) for has, name, text in files]))
    return orders.select(F.explode(some).alias("f")).select("f.path", "f.text")


def _stamp(k: Column, sep: str) -> Column:
    """A time of day and a day for each number, as the name of a directory."""
    day = F.floor(k / 86400)
    parts = [2000 + F.floor(day / 336), 1 + F.floor(day / 28) % 12, 1 + day % 28, F.floor(k / 3600) % 24, F.floor(k / 60) % 60, k % 60]
    text = [F.lpad(p.cast("string"), n, "0") for p, n in zip(parts, (4, 2, 2, 2, 2, 2), strict=True)]
    return F.concat(*text[:3], F.lit(sep), *text[3:])


def run_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of a tree with one run directory per supplier; some hold no file, some only a note."""
    k, balance = F.col("s_suppkey"), F.col("s_acctbal")
    run = _stamp(k, "-")
    perf = F.to_json(F.struct(balance.alias("samples_per_second"), F.col("s_name").alias("scenario")))
    acc = F.to_json(F.struct((balance / 2).alias("samples_per_second"), F.lit("late").alias("scenario"), (k % 100).cast("double").alias("rouge1")))
    results = F.to_json(F.struct((k % 7).cast("double").alias("rouge1")))
    empty = k % 5 == 0
    files = [
        (empty, "", F.lit(None)), (k % 5 == 1, "/notes.txt", F.lit("none")), (~empty & (k % 3 != 0), "/performance/benchmark_results.json", perf),
        (~empty & (k % 2 == 0), "/accuracy/benchmark_results.json", acc), (~empty & (k % 4 == 0), "/accuracy/accuracy_results.json", results),
    ]
    some = F.array_compact(F.array(*[F.when(has, F.struct(F.concat(run, F.lit(tail)).alias("path"), text.alias("text"))) for has, tail, text in files]))
    return table(spark, sf_dir, "supplier").select(F.explode(some).alias("f")).select("f.*")


def experiment_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, text) of a tree with one experiment per supplier: hidden metadata, input, one step; some lack a part."""
    k, name = F.col("s_suppkey"), F.col("s_name")
    home = F.concat(F.lit("exp"), k.cast("string"), F.lit("/"))
    at = F.concat(home, _stamp(k, "."), F.lit("/"))
    tags = F.array(F.lit("imported"), F.concat(F.lit("_version."), (k % 9).cast("string")), F.concat(F.lit("_owner."), name))
    meta = F.to_json(F.struct(name.alias("alias"), F.md5(name).alias("uid"), tags.alias("tags")))
    given = F.to_json(F.struct(F.struct(F.lit("main").alias("branch"), tags.alias("tags")).alias("input"), k.cast("string").alias("uid")))
    step = F.to_json(F.struct(F.concat(F.lit("run "), name).alias("cmd"), k.cast("string").alias("uid_step")))
    files = [
        (k % 4 != 0, home, "_cm.json", F.when(k % 11 == 0, "[]").otherwise(meta)), (k % 6 != 1, at, "x-input.json", given),
        (k % 6 != 1, at, "step-1/x-input-step.json", step), (k % 10 == 3, home, "other", F.lit(None)),
    ]
    some = F.array_compact(F.array(*[F.when(has, F.struct(F.concat(place, F.lit(tail)).alias("path"), text.alias("text"))) for has, place, tail, text in files]))
    return table(spark, sf_dir, "supplier").select(F.explode(some).alias("f")).select("f.*")


def published_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(
        F.concat(F.lit("pub"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.col("c_acctbal").alias("samples_per_second"),
        F.col("c_mktsegment").alias("segment"),
    )


# --- fixed values: lines of a summary log, in its order ----------------------------
LOG_LINES = [
    "50.00 percentile latency", "90.00 percentile latency", "99.00 percentile latency",
    "Min First Token latency", "Max First Token latency", "Mean First Token latency",
    "50.00 percentile first token latency", "90.00 percentile first token latency", "95.00 percentile first token latency",
    "97.00 percentile first token latency", "99.00 percentile first token latency", "99.90 percentile first token latency",
    "Min Time to Output Token", "Max Time to Output Token", "Mean Time to Output Token",
    "50.00 percentile time to output token", "90.00 percentile time to output token", "95.00 percentile time to output token",
    "97.00 percentile time to output token", "99.00 percentile time to output token", "99.90 percentile time to output token",
]
# --- end of fixed values -------------------------------------------------------------


def log_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One summary log text per event: (run_id, text, samples)."""
    ev = events(spark, sf_dir)
    k = F.col("k")
    lines = [
        F.concat(F.lit("Completed samples per second    : "), F.col("value").cast("string")),
        F.concat(F.lit("Completed tokens per second : "), k.cast("string")),
        F.concat(F.lit("Result is : "), F.when(F.col("event_type") == "error", "INVALID").otherwise("VALID")),
        F.when(k % 2 == 0, F.lit("Early stopping satisfied")),
        F.concat(F.lit("Mean latency (ns) : "), k.cast("string"), F.lit(".5e+06")),
        *[F.concat(F.lit(f"{label} (ns)   : "), (k * n + n).cast("string")) for n, label in enumerate(LOG_LINES, 2)],
    ]
    return ev.select(F.col("event_id").cast("string").alias("run_id"), F.concat_ws("\n", *lines).alias("text"), F.col("k").alias("samples"))
