"""Readers for result files, run directories, logs, rules, prompts and experiments."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.logs import extract_log_metrics
from ..schema import accuracy_result_schema, benchmark_result_schema
from .tree import read_tree

# --- fixed values: file names and split order --------------------------------------
RESULT_SUMMARY_GLOB = "*-result-summary.json"
RUN_FILES = {
    "performance": "performance/benchmark_results.json",
    "accuracy": "accuracy/benchmark_results.json",
    "accuracy_results": "accuracy/accuracy_results.json",
}
SPLITS = ["train", "test", "validation", "default"]
# --- end of fixed values -------------------------------------------------------------


def _whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, text) of every file below ``path``."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_result_summaries(
    spark: SparkSession, base: str, schema: T.StructType | None = None, glob: str = RESULT_SUMMARY_GLOB
) -> DataFrame:
    """All records of the result files below ``base``; columns are the union of all keys.

    Keys may differ only by case, so the session must run with
    ``spark.sql.caseSensitive=true``. A schema saves the inference pass over the files.
    """
    if spark.conf.get("spark.sql.caseSensitive") != "true":
        raise ValueError("set spark.sql.caseSensitive=true: raw keys can differ by case only")
    reader = (
        spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("multiLine", True)
    )
    return (reader.schema(schema) if schema is not None else reader).json(base)


def run_stamp(name: Column) -> Column:
    """ISO time of a ``YYYYMMDD-HHMMSS`` name, or null."""
    parts = r"^(\d{4})(\d{2})(\d{2})-(\d{2})(\d{2})(\d{2})$"
    iso = F.regexp_replace(name, parts, "$1-$2-$3T$4:$5:$6")
    return F.when(name.rlike(parts) & iso.try_cast("timestamp_ntz").isNotNull(), iso)


def is_run_name(name: Column) -> Column:
    """Digits with at least one ``-`` or ``_``, eight characters or more."""
    return name.rlike(r"^[0-9_-]{8,}$") & name.rlike("[-_]") & name.rlike("[0-9]")


def parse_run_files(files: DataFrame) -> DataFrame:
    """(run_id, run_dir, datetime, kind, text) of (path, text) rows that are run files."""
    place = r"^(.*/([^/]+))/(performance/benchmark_results|accuracy/benchmark_results|accuracy/accuracy_results)\.json$"
    kind = F.regexp_extract("path", place, 3)
    case = F
    for name, tail in RUN_FILES.items():
        case = case.when(kind == tail.removesuffix(".json"), F.lit(name))
    return (
        files.where(F.col("path").rlike(place))
        .select(
            F.regexp_extract("path", place, 2).alias("run_id"),
            F.regexp_extract("path", place, 1).alias("run_dir"),
            case.alias("kind"),
            "text",
        )
        .where(is_run_name(F.col("run_id")))
        .withColumn("datetime", run_stamp(F.col("run_id")))
    )


def parse_documents(texts: DataFrame, schema: T.StructType, key: str = "run_id") -> DataFrame:
    """Key, the fields of ``schema`` and ``extra`` of (key, text) rows that are JSON objects.

    ``extra`` maps all other non-null keys to their JSON text. A value that its field's type cannot hold is null in the
    field and kept in ``extra``. Text that is no JSON object, and the empty object, give no row.
    """
    is_object = F.col("text").rlike(r"^\s*\{") & ~F.col("text").rlike(r"^\s*\{\s*\}\s*$")
    docs = texts.where(is_object).select(key, F.from_json("text", "map<string,string>").alias("_doc"))
    fields = [f.name for f in schema.fields]
    typed = docs.where(F.col("_doc").isNotNull()).select(
        key, "_doc", *[F.try_element_at("_doc", F.lit(f.name)).try_cast(f.dataType).alias(f.name) for f in schema.fields]
    )
    held = F.array_compact(F.array(*[F.when(F.col(n).isNotNull(), F.lit(n)) for n in fields]))
    with_held = typed.withColumn("_held", held)
    extra = F.map_filter("_doc", lambda k, v: v.isNotNull() & ~F.array_contains("_held", k))
    return with_held.select(key, *fields, extra.alias("extra"))


def run_halves(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Performance, accuracy and accuracy-result tables plus the list of runs.

    Text that is no JSON object, and the empty object, count as an absent file. Keys without a column, such as those of a
    sweep, are kept in ``extra``.
    """
    # The directory supplies the time unless the file itself has one.
    record = T.StructType([T.StructField("datetime", T.StringType()), *benchmark_result_schema().fields])

    def half(kind: str, schema: T.StructType) -> DataFrame:
        return parse_documents(files.where(F.col("kind") == kind), schema)

    listing = files.groupBy("run_id").agg(F.min("run_dir").alias("run_dir"), F.min("datetime").alias("datetime"))
    return (
        half("performance", record),
        half("accuracy", record),
        half("accuracy_results", accuracy_result_schema()),
        listing,
    )


def run_directories(entries: DataFrame) -> DataFrame:
    """(run_id, run_dir, datetime) of the directories that are runs, whatever they hold."""
    runs = entries.where(F.col("is_dir") & is_run_name(F.col("name")))
    return runs.groupBy(F.col("name").alias("run_id")).agg(F.min("path").alias("run_dir"), F.min(run_stamp(F.col("name"))).alias("datetime"))


def read_run_directories(spark: SparkSession, base: str, empty_runs: bool = True):
    """Halves and listing of the run directories below ``base``.

    A run is a directory, also one without a file. Spark lists files only, so the directories come from
    :func:`tree.read_tree`; in a store that only Spark reads, ``empty_runs=False`` leaves out those without a result file.
    """
    perf, acc, results, listing = run_halves(parse_run_files(_whole_files(spark, base, "*_results.json")))
    return perf, acc, results, run_directories(read_tree(spark, base)) if empty_runs else listing


def read_published(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """Published Parquet table. Below ``path`` each split is a directory; the first present
    one of train, test, validation, default is read, else the table at ``path`` itself."""
    for name in [split] if split else SPLITS:
        try:
            return spark.read.parquet(f"{path.rstrip('/')}/{name}")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
    if split:
        raise ValueError(f"no split {split!r} in {path}")
    return spark.read.option("recursiveFileLookup", True).parquet(path)


def parse_prices(files: DataFrame) -> DataFrame:
    """(name, price_per_hour) of JSON object texts in (path, text) rows; the last of repeated names wins.

    A value that is no number (also a nested object) gives a null price; text that is no object gives nothing.
    """
    entries = F.from_json("text", "map<string,string>")
    return (
        files.select("path", F.posexplode(entries).alias("pos", "name", "price"))
        .groupBy("name")
        .agg(F.max_by(F.col("price").try_cast("double"), F.struct("path", "pos")).alias("price_per_hour"))
    )


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    """(name, price_per_hour) of the JSON objects below ``path``."""
    return parse_prices(_whole_files(spark, path))


def read_prompts(
    spark: SparkSession, path: str, input_col: str, output_col: str | None = None,
    system_col: str | None = None, index_col: str = "sample_idx", fmt: str = "parquet", split: str | None = None,
) -> DataFrame:
    """(sample_idx, input[, reference][, system_prompt]) of a prompt table.

    The table must carry its own index: rows of a distributed table have no position.
    """
    df = read_published(spark, path, split) if fmt == "parquet" else spark.read.format(fmt).load(path)
    mapping = {"sample_idx": index_col, "input": input_col, "reference": output_col, "system_prompt": system_col}
    return df.select(*[F.col(c).alias(n) for n, c in mapping.items() if c])


def read_run_logs(spark: SparkSession, path: str, glob: str = "*summary.txt", strict: bool = False) -> DataFrame:
    """One typed row per summary log file, keyed by the name of its directory."""
    logs = _whole_files(spark, path, glob).withColumn("run_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return extract_log_metrics(logs, "text", strict).drop("text")


def read_accuracy_log(spark: SparkSession, path: str) -> DataFrame:
    """(qsl_idx, data) records of JSON array files."""
    return spark.read.option("multiLine", True).schema("qsl_idx long, data string").json(path)


def parse_rules(lines: DataFrame, layer: int = 0, col: str = "value") -> DataFrame:
    """(layer, model, scenario, key, value, value_str) of ``model.scenario.key = value`` lines."""
    rule = r"^\s*([^#.\s=]+)\.([^.\s=]+)\.([^.\s=]+)\s*=\s*(\S+)\s*$"
    return lines.where(F.col(col).rlike(rule)).select(
        F.lit(layer).alias("layer"),
        *[F.regexp_extract(col, rule, i + 1).alias(n) for i, n in enumerate(["model", "scenario", "key"])],
        # Seeds exceed the exact range of a double, so the text is kept beside the number.
        F.regexp_extract(col, rule, 4).try_cast("double").alias("value"),
        F.regexp_extract(col, rule, 4).alias("value_str"),
    )


def read_rules(spark: SparkSession, path: str, user_path: str | None = None) -> DataFrame:
    """Base rule file and, one layer above it, the user's file."""
    rules = parse_rules(spark.read.text(path))
    return rules if user_path is None else rules.unionByName(parse_rules(spark.read.text(user_path), 1))


SWEEP_POINT = T.StructType(
    [
        *benchmark_result_schema().fields,
        T.StructField("target_qps", T.DoubleType()),
        T.StructField("qps", T.DoubleType()),
        T.StructField("error", T.StringType()),
    ]
)


def read_sweeps(spark: SparkSession, path: str) -> DataFrame:
    """One row per sweep point; a failed point has ``error`` and its target rate."""
    schema = T.StructType(
        [T.StructField("max_throughput", T.DoubleType()), T.StructField("sweep_results", T.ArrayType(SWEEP_POINT))]
    )
    docs = spark.read.option("multiLine", True).option("recursiveFileLookup", True).schema(schema).json(path)
    return docs.select(
        F.col("_metadata.file_path").alias("sweep_id"),
        "max_throughput",
        F.inline_outer("sweep_results"),
    ).withColumn("target_qps", F.coalesce("target_qps", "qps")).drop("qps")


def tag_map(tags: Column) -> Column:
    """``_key.value`` tags as a map; the key ends at the first dot, the last of a key wins."""
    from ..functions.hardware import entries_to_map

    keyed = F.filter(tags, lambda t: t.rlike(r"^_[^.]*\."))
    entries = F.transform(
        keyed,
        lambda t: F.struct(
            F.regexp_extract(t, r"^_([^.]*)\.", 1).alias("key"),
            F.regexp_replace(t, r"^_[^.]*\.", "").alias("value"),
        ),
    )
    return entries_to_map(entries)


def plain_tags(tags: Column) -> Column:
    return F.sort_array(F.array_distinct(F.filter(tags, lambda t: ~t.rlike(r"^_[^.]*\."))))


EXPERIMENT_INPUT = (
    "input struct<alias:string,automation_alias:string,automation_uid:string,benchmark:string,"
    "branch:string,git:boolean,live:boolean,main:boolean,submission:boolean,tags:array<string>,"
    "uid:string,url:string,version:string>, uid string"
)


EXPERIMENT_META = "alias string, automation_alias string, automation_uid string, tags array<string>, uid string"


def parse_experiment_meta(files: DataFrame) -> DataFrame:
    """(experiment, meta) of (path, text) rows that are the metadata files of experiments; text that is no object is null."""
    place = r"^(?:.*/)?([^/]+)/_[^/]*\.json$"
    doc = F.from_json("text", EXPERIMENT_META)
    meta = F.struct(
        *[doc[f].alias(f) for f in ("alias", "uid", "automation_alias", "automation_uid")],
        tag_map(doc["tags"]).alias("tag_values"),
        plain_tags(doc["tags"]).alias("plain_tags"),
    )
    found = files.where(F.col("path").rlike(place) & F.col("text").isNotNull())
    by_path = found.select(F.regexp_extract("path", place, 1).alias("experiment"), "path", meta.alias("meta"))
    return by_path.groupBy("experiment").agg(F.min_by("meta", "path").alias("meta"))


def read_experiments(spark: SparkSession, base: str, hidden: bool = True) -> DataFrame:
    """One row per recorded step: experiment, its metadata, input and step metadata of a directory tree.

    Layout ``<experiment>/<YYYYMMDD.HHMMSS>/<step>/``. The metadata file of an experiment (tags, uid, alias) starts with an
    underscore, which Spark's listing hides, so it comes from :func:`tree.read_tree`; in a store that only Spark reads,
    ``hidden=False`` leaves ``meta`` null. An experiment without any input has a row of its metadata alone.
    """
    files = _whole_files(spark, base, "*.json")
    stamp = r"^(.*/([^/]+))/(\d{8}\.\d{6})"

    def kind(tail: str, schema: str) -> DataFrame:
        return files.where(F.col("path").rlike(stamp + tail)).select(
            F.regexp_extract("path", stamp, 2).alias("experiment"),
            F.regexp_extract("path", stamp, 3).alias("stamp"),
            F.regexp_extract("path", stamp + r"/([^/]+)/[^/]+$", 4).alias("step"),
            F.from_json("text", schema).alias("doc"),
        )

    inputs = kind(r"/[^/]*-input\.json$", EXPERIMENT_INPUT).select(
        "experiment", "stamp", "doc.input.*", F.col("doc.uid").alias("input_uid")
    )
    steps = kind(r"/[^/]+/[^/]*-input-step\.json$", "cmd string, env map<string,string>, iso_datetime string, uid_step string")
    results = kind(r"/[^/]+/[^/]*-result\.json$", "iso_datetime string, uid_step string")
    at = ["experiment", "stamp", "step"]
    if hidden:
        meta = parse_experiment_meta(read_tree(spark, base, "_*.json"))
    else:
        meta = parse_experiment_meta(files.limit(0))
    recorded = (
        inputs.withColumns({"tag_values": tag_map(F.col("tags")), "plain_tags": plain_tags(F.col("tags"))})
        .drop("tags")
        .join(
            steps.select(*at, F.col("doc.cmd").alias("cmd"), F.col("doc.env").alias("env"),
                         F.col("doc.iso_datetime").alias("started"), F.col("doc.uid_step").alias("uid_step"))
            .join(results.select(*at, F.col("doc.iso_datetime").alias("finished")), at, "full_outer"),
            ["experiment", "stamp"],
            "left",
        )
    )
    return (
        recorded.join(meta, "experiment", "full_outer")
        .withColumn("datetime", run_stamp(F.translate("stamp", ".", "-")))
    )
