"""Expressions that clean and classify hardware and model descriptions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip

# --- fixed values ---------------------------------------------------------------
NULL_WORDS = ["", "N/A", "DUMMY"]

ACCELERATOR_VENDORS = [
    ("NVIDIA", ["NVIDIA", "TESLA", "A100", "H100", "T4"]),
    ("AMD", ["AMD"]),
    ("Intel", ["INTEL", "HABANA", "GAUDI"]),
    ("Google", ["TPU", "TRILLIUM", "LPU", "VPU"]),
    ("Qualcomm", ["QUALCOMM", "ADRENO", "HEXAGON", "CLOUD AI 100", "SNAPDRAGON"]),
    ("UntetherAI", ["UNTETHERAIR", "SPEEDAI"]),
    ("Huawei", ["DAVINCI"]),
    ("Moffett", ["MOFFETT"]),
]

CPU_VENDORS = [
    ("AMD", ["AMD", "EPYC"]),
    ("Intel", ["INTEL", "XEON"]),
    ("NVIDIA", ["NVIDIA", "GRACE"]),
    ("ARM", ["ARM", "CORTEX", "NEOVERSE", "ARMV8"]),
    ("AWS", ["AWS", "GRAVITON"]),
    ("Apple", ["APPLE", "M1", "M2", "M3"]),
    ("Qualcomm", ["QUALCOMM", "SNAPDRAGON"]),
]

UNKNOWN_INTERCONNECTS = ["TBD", "TODO", "TODD"]

# Model name prefix (any case) -> billions of parameters.
MODEL_PARAMETERS = [
    ("llama2-70b", 70.0),
    ("llama-2-70b", 70.0),
    ("llama3_1-405b", 405.0),
    ("llama3_1-70b", 70.0),
    ("gptj", 6.0),
    ("mixtral-8x7b", 47.0),
    ("DeepSeek-R1-Distill-Llama-8B", 8.0),
    ("Llama-3.3-70B", 70.0),
    ("deepseek-v3", 671.0),
]

LLM_PATTERNS = ["llama", "gpt", "mixtral", "deepseek", "falcon", "mistral"]
# --- end of fixed values ----------------------------------------------------------


def first_match(rules: list[tuple[Column, object]], otherwise: object = None) -> Column:
    """Ordered CASE: value of the first condition that holds."""
    (cond, value), *rest = rules
    case = F.when(cond, value)
    for cond, value in rest:
        case = case.when(cond, value)
    return case.otherwise(F.lit(otherwise))


def contains_any(c: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.contains(w) for w in words])


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def clean_string(c: Column) -> Column:
    """Placeholder words become null; nothing is trimmed."""
    # Lengths are cheap to compare; only texts of a placeholder's length are upper-cased.
    lengths = sorted({len(w) for w in NULL_WORDS})

    def cleaned(text: Column) -> Column:
        return F.when(F.octet_length(text).isin(lengths) & F.upper(text).isin(NULL_WORDS), F.lit(None)).otherwise(text)

    return let(c, cleaned)


def _part_gb(text: Column) -> Column:
    number = F.regexp_extract(text, r"^([0-9.]*)", 1).try_cast("double")
    return F.when(contains_any(text, ["TB", "TIB"]), number * 1024).when(
        contains_any(text, ["GB", "GIB"]), number
    )


def memory_gb(c: Column) -> Column:
    """Memory text in GB; ``+`` adds parts, and a sum of nothing is null."""

    def total(text: Column) -> Column:
        # The sum runs from the last part to the first, which fixes its rounding.
        parts = F.aggregate(
            F.reverse(F.split(text, r"\+")),
            F.lit(0.0),
            lambda acc, part: acc + F.coalesce(_part_gb(part), F.lit(0.0)),
        )
        return F.when(text.contains("+"), F.nullif(parts, F.lit(0.0))).otherwise(_part_gb(text))

    return F.when(c.isNotNull(), let(F.upper(F.replace(c, F.lit(" "), F.lit(""))), total))


def frequency_ghz(c: Column) -> Column:
    """Largest number of the text in GHz; digits alone are MHz, as is any ``MHZ``."""
    text = F.upper(c)
    digits = F.regexp_extract(text, r"^\s*(\d+)\s*$", 1)
    top = F.array_max(F.regexp_extract_all(text, F.lit(r"([\d.]+)"), F.lit(1)).try_cast("array<double>"))
    scaled = F.when(text.contains("MHZ"), top / 1000).otherwise(top)
    return (
        F.when((c == "") | (c == "undefined"), F.lit(None).cast("double"))
        .when(digits != "", digits.try_cast("double") / 1000)
        .otherwise(scaled)
    )


def datetime_iso(c: Column) -> Column:
    """ISO text of a commit time, or null; no time zone is applied."""
    # Form 2025/04/03_22:56:53: separators are replaced, the tail stays as written.
    swapped = F.translate(c, "/_", "-T")
    tail = r"^\d{4}-\d{2}-\d{2}T([01]\d|2[0-3])(:[0-5]\d(:[0-5]\d([.,]\d+)?)?)?(Z|[+-]\d{2}(:?[0-5]\d)?)?$"
    swapped_ok = swapped.rlike(tail) & F.substring(swapped, 1, 10).try_cast("date").isNotNull()
    # Forms 2025-04-03 22:56:53, 2025/04/03 22:56:53 and 2025-04-03T22:56:53.
    clock = r"\d{1,2}:\d{1,2}:\d{1,2}$"
    day = r"^\d{4}-\d{1,2}-\d{1,2}"
    plain_ok = c.rlike(f"{day}[ T]{clock}") | c.rlike(rf"^\d{{4}}/\d{{1,2}}/\d{{1,2}} {clock}")
    stamp = F.translate(c, "/", "-").try_cast("timestamp_ntz")
    return F.when(
        c.contains("/") & c.contains("_"), F.when(swapped_ok, swapped)
    ).when(plain_ok, F.translate(stamp.cast("string"), " ", "T"))


def interconnect(c: Column) -> Column:
    """Family name of an interconnect; unknown texts pass through unchanged."""
    text = F.upper(c)

    def has(word: str) -> Column:
        return text.contains(word)

    return (
        F.when(text.isin(UNKNOWN_INTERCONNECTS), F.lit(None).cast("string"))
        .when(has("NVLINK") & has("5TH"), F.lit("NVLink-5"))
        .when(has("NVLINK") & has("4TH"), F.lit("NVLink-4"))
        .when(has("NVLINK"), F.lit("NVLink"))
        .when(
            has("PCIE") & F.replace(text, F.lit(" "), F.lit("")).contains("GEN5"),
            F.lit("PCIe-5"),
        )
        .when(has("PCIE"), F.lit("PCIe"))
        .when(has("INFINIBAND"), F.lit("InfiniBand"))
        .when(has("XGMI"), F.lit("XGMI"))
        .otherwise(c)
    )


def keyword_class(c: Column, rules: list[tuple[str, list[str]]]) -> Column:
    """First class, in rule order, one of whose keywords occurs in the upper-case text."""
    text = F.upper(c)
    return first_match([(contains_any(text, words), F.lit(name)) for name, words in rules])


def model_parameters(c: Column) -> Column:
    text = F.lower(c)
    return first_match(
        [(text.startswith(p.lower()), F.lit(n)) for p, n in MODEL_PARAMETERS]
    ).cast("double")


def model_architecture(c: Column) -> Column:
    return F.when(c != "", F.when(contains_any(F.lower(c), LLM_PATTERNS), "LLM").otherwise("Other"))


def framework_entries(c: Column) -> Column:
    """``name version`` items of a comma list, as array<struct<name, version>>."""
    items = F.transform(
        F.transform(F.split(c, ","), strip),
        lambda item: F.struct(
            F.lower(F.regexp_extract(item, r"(?U)(\w+)\s+", 1)).alias("name"),
            F.regexp_extract(item, r"(?U)\s+([\d.]+)", 1).alias("version"),
        ),
    )
    found = F.filter(items, lambda e: (e["name"] != "") & (e["version"] != ""))
    return F.transform(
        found,
        lambda e: F.struct(e["name"].alias("name"), F.btrim(e["version"], F.lit(".")).alias("version")),
    )


def accuracy_entries(c: Column) -> Column:
    """``KEY: value`` items parted by two spaces, as array<struct<key, value>>."""
    pairs = F.transform(F.split(c, "  "), lambda item: F.split(item, ": "))
    usable = F.filter(
        pairs, lambda p: (F.size(p) == 2) & (F.get(p, F.lit(0)) != "") & (F.get(p, F.lit(1)) != "")
    )
    return F.transform(
        usable,
        lambda p: F.struct(
            F.lower(F.trim(F.get(p, F.lit(0)))).alias("key"),
            F.trim(F.get(p, F.lit(1))).try_cast("double").alias("value"),
        ),
    )


def entries_to_map(entries: Column, key: str = "key", value: str = "value") -> Column:
    """Map of an entry array in which a key may repeat; its last entry survives."""

    def build(items: Column) -> Column:
        def last_of_each(keys: Column) -> Column:
            n = F.size(items)
            return F.filter(items, lambda e, i: i == n - F.array_position(keys, e[key]))

        kept = let(F.reverse(F.transform(items, lambda e: e[key])), last_of_each)
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e[key], e[value])))

    return F.when(entries.isNotNull(), let(entries, build))


def within_tolerance(a: Column, b: Column, tol: float = 0.1) -> Column:
    """Relative closeness; null matches only null and zero only zero."""
    gap = F.try_divide(F.abs(a - b), F.greatest(F.abs(a), F.abs(b)))
    return (
        F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull())
        .when((a == 0) | (b == 0), a == b)
        .otherwise(gap <= tol)
    )


def percent_of(delta: Column, base: Column) -> Column:
    """``delta`` in percent of ``base``; 0 where the base is 0."""
    return F.when(base == 0, F.lit(0.0)).otherwise(F.try_divide(delta, base) * 100)
