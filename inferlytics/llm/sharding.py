"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size (a start and a stride from its name).
The shards take turns, each claiming its next preferred slot that is still free, until the table is full; so all own
nearly equally many slots, and a shard that comes or goes leaves nearly all other slots as they were. A row's slot is the
hash of its key modulo the table size; the table is broadcast, its size being a parameter, and gives the shard at once.

Nulls and odd input: rows whose keys are all null share one slot; repeated keys share one shard; an empty table gives an
empty result; columns named slot or shard are replaced. Only DataFrame functions are used on rows.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inferlytics.llm.common import shared_folder, table

SIZE = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _hash(name: str, purpose: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{purpose}:{name}".encode()).digest()[:8], "big")


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def fill(shards: Sequence[str], size: int = SIZE) -> list[int]:
    """Owner of each slot, as an index into ``shards``."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or size < len(shards):
        raise ValueError("the table size must be a prime of at least the number of shards")
    at = [_hash(name, "start") % size for name in shards]
    stride = [_hash(name, "stride") % (size - 1) + 1 for name in shards]
    owner = [-1] * size
    free = size
    while True:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % size
            owner[at[k]] = k
            free -= 1
            if not free:
                return owner


def lookup_table(spark: SparkSession, shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """(slot, shard): ``size`` rows."""
    owners = F.split(F.lit(",".join(map(str, fill(shards, size)))), ",")
    names = F.array(*[F.lit(s) for s in shards])
    slots = spark.range(1).select(F.posexplode(owners).alias("slot", "owner"))
    return slots.select("slot", F.element_at(names, F.col("owner").cast("int") + 1).alias("shard"))


def place(rows: DataFrame, keys: Sequence[str] = ("doc_id",), shards: Sequence[str] = SHARDS, size: int = SIZE) -> DataFrame:
    """The rows with ``slot`` and ``shard``."""
    rows = rows.drop("slot", "shard").withColumn("slot", F.pmod(F.xxhash64(*keys), F.lit(size)).cast("int"))
    return rows.join(F.broadcast(lookup_table(rows.sparkSession, shards, size)), "slot")


def write_shards(rows: DataFrame, path: str, keys: Sequence[str] = ("doc_id",), shards: Sequence[str] = SHARDS, size: int = SIZE) -> None:
    """Whole rows in one folder per shard.

    Rows are gathered by shard so that files are few, but a shard is not a task: Spark splits what is more than the advisory
    partition size and joins what is less, so a shard with a third of all rows (one repeated or null key) is many tasks.
    """
    placed = place(rows, keys, shards, size)
    placed.hint("rebalance", F.col("shard")).write.option("compression", "zstd").partitionBy("shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    """Where each document was written, as read back from the shards."""
    path = f"{shared_folder(spark)}/shards-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    write_shards(docs, path)
    kept = docs.drop("slot", "shard").schema.add("slot", "integer").add("shard", "string")
    return spark.read.schema(kept).parquet(path).select("doc_id", "slot", "shard")
