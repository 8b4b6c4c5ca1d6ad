"""Canonical result schema, feature catalogue and column-name helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def qcol(name: str) -> Column:
    """Column by literal name; canonical names contain dots and need quoting."""
    return F.col(f"`{name.replace('`', '``')}`")


# --- fixed values: canonical columns (name, type, feature group, kind) --------
# A blank group marks a column that is carried but is not a described feature.
CANONICAL_COLUMNS = [
    ("benchmark.name", "string", "", "categorical"),
    ("benchmark.version", "string", "", "categorical"),
    ("datetime", "string", "", "categorical"),
    ("metrics.result", "double", "Performance", "continuous"),
    ("metrics.result_per_accelerator", "double", "Performance", "continuous"),
    ("metrics.accuracy", "string", "Performance", "continuous"),
    ("metrics.units", "string", "", "categorical"),
    ("model.name", "string", "Model", "categorical"),
    ("model.mlperf_name", "string", "Model", "categorical"),
    ("model.architecture", "string", "Model", "categorical"),
    ("model.number_of_parameters", "double", "Model", "continuous"),
    ("model.weight_data_types", "string", "Model", "categorical"),
    ("system.accelerator.vendor", "string", "Accelerator", "categorical"),
    ("system.accelerator.name", "string", "Accelerator", "categorical"),
    ("system.accelerator.count_per_node", "long", "Accelerator", "continuous"),
    ("system.accelerator.total_count", "long", "Accelerator", "continuous"),
    ("system.accelerator.memory_capacity", "double", "Accelerator", "continuous"),
    ("system.accelerator.memory_config", "string", "Accelerator", "text"),
    ("system.interconnect.accelerator", "string", "Accelerator", "categorical"),
    ("system.cpu.vendor", "string", "CPU", "categorical"),
    ("system.cpu.model", "string", "CPU", "categorical"),
    ("system.cpu.core_count", "long", "CPU", "continuous"),
    ("system.cpu.count_per_node", "long", "CPU", "continuous"),
    ("system.cpu.frequency", "double", "CPU", "continuous"),
    ("system.cpu.caches", "string", "CPU", "text"),
    ("system.cpu.vcpu_count", "string", "CPU", "continuous"),
    ("system.name", "string", "System", "text"),
    ("system.type", "string", "System", "categorical"),
    ("system.cooling", "string", "System", "categorical"),
    ("system.number_of_nodes", "long", "System", "continuous"),
    ("system.memory.capacity", "double", "System", "continuous"),
    ("system.memory.configuration", "string", "System", "text"),
    ("system.interconnect.accelerator_host", "string", "System", "categorical"),
    ("software.framework", "string", "Software", "categorical"),
    ("software.version", "string", "Software", "categorical"),
    ("software.operating_system", "string", "Software", "categorical"),
    ("submission.organization", "string", "Submission", "categorical"),
    ("submission.division", "string", "Submission", "categorical"),
    ("submission.scenario", "string", "Submission", "categorical"),
    ("submission.availability", "string", "Submission", "boolean"),
    ("submission.debug_uid", "string", "Submission", "text"),
]

# --- fixed values: raw key -> canonical column, in order of precedence --------
# When several raw keys feed one column, the later entry wins.
ALIASES = [
    ("Accuracy", "metrics.accuracy"),
    ("Availability", "submission.availability"),
    ("Organization", "submission.organization"),
    ("Division", "submission.division"),
    ("Scenario", "submission.scenario"),
    ("Result", "metrics.result"),
    ("Units", "metrics.units"),
    ("MlperfModel", "model.mlperf_name"),
    ("Model", "model.name"),
    ("weight_data_types", "model.weight_data_types"),
    ("framework", "software.framework"),
    ("operating_system", "software.operating_system"),
    ("SystemName", "system.name"),
    ("system.system_name", "system.name"),
    ("SystemType", "system.type"),
    ("system.system_type", "system.type"),
    ("accelerator_model_name", "system.accelerator.name"),
    ("system.accelerator_model_name", "system.accelerator.name"),
    ("number_of_nodes", "system.number_of_nodes"),
    ("accelerators_per_node", "system.accelerator.count_per_node"),
    ("system.accelerators_per_node", "system.accelerator.count_per_node"),
    ("host_processor_core_count", "system.cpu.core_count"),
    ("system.host_processor_core_count", "system.cpu.core_count"),
    ("host_processor_model_name", "system.cpu.model"),
    ("system.host_processor_model_name", "system.cpu.model"),
    ("host_processors_per_node", "system.cpu.count_per_node"),
    ("system.host_processors_per_node", "system.cpu.count_per_node"),
    ("cooling", "system.cooling"),
    ("system.cooling", "system.cooling"),
    ("system.accelerator_host_interconnect", "system.interconnect.accelerator_host"),
    ("system.accelerator_interconnect", "system.interconnect.accelerator"),
    ("system.accelerator_memory_capacity", "system.accelerator.memory_capacity"),
    ("system.accelerator_memory_configuration", "system.accelerator.memory_config"),
    ("system.host_memory_capacity", "system.memory.capacity"),
    ("system.host_memory_configuration", "system.memory.configuration"),
    ("system.host_processor_frequency", "system.cpu.frequency"),
    ("system.host_processor_caches", "system.cpu.caches"),
    ("system.host_processor_vcpu_count", "system.cpu.vcpu_count"),
    ("benchmark_name", "benchmark.name"),
    ("benchmark_version", "benchmark.version"),
    ("datetime_last_commit", "datetime"),
    ("debug_uid", "submission.debug_uid"),
]
# --- end of fixed values -------------------------------------------------------

INTEGER_COLUMNS = [
    "system.cpu.core_count",
    "system.accelerator.count_per_node",
    "system.cpu.count_per_node",
    "system.number_of_nodes",
]
MEMORY_COLUMNS = ["system.accelerator.memory_capacity", "system.memory.capacity"]
INTERCONNECT_COLUMNS = ["system.interconnect.accelerator", "system.interconnect.accelerator_host"]

#: Columns that exist before any derivation; numbers still arrive as text.
RAW_COLUMNS = {
    name: ("double" if name == "metrics.result" else "string")
    for name in dict.fromkeys(target for _, target in ALIASES)
}

FEATURE_KIND = {name: kind for name, _, group, kind in CANONICAL_COLUMNS if group}


def feature_kind(name: str) -> str:
    """Kind of a feature; a column nobody described counts as categorical."""
    return FEATURE_KIND.get(name, "categorical")


def canonical_schema() -> T.StructType:
    """Schema of the finished table; group and kind sit in the field metadata."""
    schema = T.StructType()
    for name, type_name, group, kind in CANONICAL_COLUMNS:
        schema.add(name, type_name, True, {"group": group, "kind": kind})
    return schema


def conform(df: DataFrame, columns: dict[str, str] | None = None) -> DataFrame:
    """Add the canonical raw columns that ``df`` lacks as typed nulls."""
    wanted = RAW_COLUMNS if columns is None else columns
    present = set(df.columns)
    missing = {n: F.lit(None).cast(t).alias(n) for n, t in wanted.items() if n not in present}
    return df.select("*", *missing.values()) if missing else df


def with_feature_metadata(df: DataFrame) -> DataFrame:
    """Attach feature group and kind to every described column of ``df``."""
    info = {name: {"group": group, "kind": kind} for name, _, group, kind in CANONICAL_COLUMNS}
    return df.select(
        *[
            qcol(c).alias(c, metadata=info.get(c, {"group": "", "kind": "categorical"}))
            for c in df.columns
        ]
    )


def feature_catalogue(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: name, type, feature group, kind."""
    groups = {name: group for name, _, group, _ in CANONICAL_COLUMNS}
    rows = [
        (f.name, f.dataType.simpleString(), groups.get(f.name) or None, feature_kind(f.name))
        for f in df.schema.fields
    ]
    return df.sparkSession.createDataFrame(
        rows, "column string, type string, feature_group string, kind string"
    )


def plain_names(df: DataFrame) -> DataFrame:
    """Replace dots in column names, for sinks that do not accept them."""
    return df.select(*[qcol(c).alias(c.replace(".", "_")) for c in df.columns])


def struct(**fields: str | T.DataType) -> T.StructType:
    """Schema from names and types; unlike DDL text it needs no session."""
    schema = T.StructType()
    for name, kind in fields.items():
        schema.add(name, kind)
    return schema


def request_schema() -> T.StructType:
    """One served request, as written by a load generator client."""
    return struct(
        success="boolean", prompt_len="integer", ttft="double", latency="double", output_tokens="integer",
        itl=T.ArrayType(T.DoubleType()), generated_text="string", error="string", batch_size="integer",
    )


_LATENCY_STATS = ["min", "max", "mean", "p50", "p90", "p95", "p97", "p99", "p99_9"]


def benchmark_result_schema() -> T.StructType:
    """One finished benchmark run."""
    schema = struct(
        scenario="string", mode="string", valid="boolean", completed="long", total_samples="long",
        samples_per_second="double", tokens_per_second="double",
    )
    for stat in ["mean", "p50", "p90", "p99"]:
        schema.add(f"{stat}_latency_ns", "double")
    for family in ["first_token_latency_ns", "tpot_ns"]:
        for stat in _LATENCY_STATS:
            schema.add(f"{stat}_{family}", "double")
    for name in ["rouge1", "rouge2", "rougeL"]:
        schema.add(name, "double")
    return schema.add("gen_len", "long").add("tokens_per_sample", "double")


def accuracy_result_schema() -> T.StructType:
    """Corpus accuracy record of one run."""
    return struct(
        rouge1="double", rouge2="double", rougeL="double", rougeLsum="double", gen_len="long",
        gen_num="long", gen_tok_len="long", tokens_per_sample="double", error="string",
    )
