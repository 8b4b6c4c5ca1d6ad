"""Exact top-k inner products by exhaustive term-at-a-time accumulation.

Candidates are packed into blocks, and a block is turned into postings: for each component (term) the rows that have it
and their weights. A query walks its own non-zero terms and adds weight times posting into a dense score array over the
block; the k best of the array are cut out by partial selection. Query packs meet every block through an equality join on
the block number, so no block or pack grows with the data, and the lists of all blocks are merged by rank.

Vectors that are null or hold a null or non-finite component take no part, nor do rows without an id. Vectors of unequal
length count missing components as zero. Repeated rows are candidates each; a query never meets a row of its own id, and
a query that is repeated, or whose id has several vectors, is asked once per different vector.
Scores tie to the smaller vec_id. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inferlytics.llm.common import settle, table

SCALE = 64
K = 20
BLOCK = 4096  # candidates per block: its score array stays in a core's cache
PACK = 512  # queries per pack
FOUND = "query_id long, vec_id long, score long"


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integer vectors of the rows that take part."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.forall(x, finite))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e * scale)).alias("v"))


def _pack(size: int):
    """Rows as packs of ``size``: ids and vectors as bytes of 64-bit integers, row by row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                lists = part.column(1)
                lengths = np.diff(lists.offsets.to_numpy())
                dims = int(lengths.max(initial=0))
                dense = np.zeros((len(lengths), dims), np.int64)
                dense[np.arange(dims)[None, :] < lengths[:, None]] = lists.flatten().to_numpy()
                columns = [pa.array([part.column(0).to_numpy().tobytes()], pa.binary()), pa.array([dense.tobytes()], pa.binary())]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([dims], pa.int32())], ["ids", "data", "dims"])

    return run


PACKED = "ids binary, data binary, dims int"


class _Postings:
    """Postings of one block, by term; a list that holds over half of the block is kept as a full row."""

    def __init__(self, vectors: np.ndarray, dtype: type):
        self.lists: list[tuple[np.ndarray | None, np.ndarray]] = []
        for weights in vectors.T.astype(dtype):
            rows = np.flatnonzero(weights)
            full = 2 * len(rows) > len(weights)
            self.lists.append((None, np.ascontiguousarray(weights)) if full else (rows, weights[rows]))
        self.scores = np.zeros(len(vectors), dtype)
        self.scratch = np.zeros(len(vectors), dtype)

    def score(self, query: np.ndarray) -> np.ndarray:
        self.scores[:] = 0
        for term in np.flatnonzero(query[: len(self.lists)]).tolist():
            rows, weights = self.lists[term]
            product = np.multiply(weights, query[term], out=self.scratch[: len(weights)])
            if rows is None:
                np.add(self.scores, product, out=self.scores)
            else:
                self.scores[rows] += product
        return self.scores


def best(scores: np.ndarray, ids: np.ndarray, own: int, k: int) -> np.ndarray:
    """Positions of the k best rows other than ``own``: higher score first, then smaller id."""
    take = min(len(scores), k + int((ids == own).sum()))
    if not take:
        return np.zeros(0, np.int64)
    least = np.partition(scores, len(scores) - take)[len(scores) - take]
    above, ties = np.flatnonzero(scores > least), np.flatnonzero(scores == least)
    need = take - len(above)
    if len(ties) > need:
        ties = ties[np.argpartition(ids[ties], need - 1)[:need]] if not (ids[ties] == own).any() else ties[np.argsort(ids[ties])]
    at = np.concatenate([above, ties])
    at = at[ids[at] != own]
    return at[np.lexsort((ids[at], -scores[at]))][:k]


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                ids, asked = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["q_ids"], np.int64)
                block = np.frombuffer(row["data"], np.int64).reshape(len(ids), row["dims"])
                queries = np.frombuffer(row["q_data"], np.int64).reshape(len(asked), row["q_dims"])
                bound = float(np.abs(block).max(initial=0)) * float(np.abs(queries).max(initial=0)) * min(row["dims"], row["q_dims"])
                dtype = np.int32 if bound < 2**31 else np.int64
                postings = _Postings(block, dtype)
                found = []
                for own, query in zip(asked.tolist(), queries.astype(dtype), strict=True):
                    scores = postings.score(query)
                    at = best(scores, ids, own, k)
                    found.append((np.full(len(at), own), ids[at], scores[at].astype(np.int64)))
                columns = [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "vec_id", "score"])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, pack: int = PACK) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best rows; both tables are (vec_id, v) as :func:`usable` gives."""
    blocks = settle(vectors.mapInArrow(_pack(block), PACKED).withColumn("block", F.monotonically_increasing_id()), "blocks")
    packs = queries.mapInArrow(_pack(pack), PACKED).select(*[F.col(c).alias(f"q_{c}") for c in ("ids", "data", "dims")])
    numbers = blocks.select(F.dense_rank().over(Window.orderBy("block")).alias("cell"), "block")  # one row per 4096 vectors
    blocks = settle(blocks.join(numbers, "block").drop("block"), "cells")
    cells = blocks.agg(F.coalesce(F.max("cell"), F.lit(0))).first()[0]
    asked = packs.select("*", F.explode(F.sequence(F.lit(1), F.lit(cells))).alias("cell")) if cells else packs.withColumn("cell", F.lit(0)).limit(0)
    pairs = blocks.join(asked, "cell").select("ids", "data", "dims", "q_ids", "q_data", "q_dims")
    found = pairs.mapInArrow(_search(k), FOUND)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    vectors = settle(usable(table(spark, sf_dir, "embeddings")), "vectors")
    return top_k(vectors, vectors.where(F.col("vec_id") % 20 == 0).distinct())


ORACLE = """
WITH e AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM e WHERE vec_id % 20 = 0) q JOIN e c ON c.vec_id <> q.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s
) WHERE rank <= 20
"""
