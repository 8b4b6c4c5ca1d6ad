"""Vector code compression: each part of a vector becomes the number of its nearest codebook entry, found by Orchard search.

Vectors are cut into ``parts`` equal parts, each with a codebook of ``entries`` entries, trained in ``rounds`` rounds.
A round is one pass: tasks find the nearest entries of their rows and give back sums and counts per (part, entry,
component), which Spark adds up; the driver sees no more than one number per component of the codebooks. No vector is
ever shuffled.

Nearest entries: every entry has the list of all entries sorted by distance from it. A search walks the list of its
present entry, skips what it has visited, jumps to the list of an entry that is nearer (or as near, with a smaller number),
and stops where the list goes beyond twice the present distance: nothing further can be nearer. All distances are whole
numbers, so results are exact and the same however rows are dealt.

Odd input: vectors that are null or hold null or non-finite components are dropped. A shorter vector is filled up with
zeros, to the longest one's length rounded up to a multiple of ``parts``. Components are held within the range whose
squared distances fit 64 bits (for 64 components: 32,768 on either side). The first entries are the rows with the smallest
vec_ids, nulls last, ties by vector; a table of fewer rows has fewer entries. Repeated rows count as often as they occur.
A label sum over 64 bits is null. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from inferlytics.llm.common import settle, table

SCALE = 4096
PARTS = 8
ENTRIES = 16
ROUNDS = 6
SUMS = "part int, entry int, place int, total long, n long"


def usable(vectors: DataFrame, label: Column, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, v): whole-number vectors of the rows that take part."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))

    x = F.transform("embedding", lambda e: e.cast("double"))
    rows = vectors.where(F.col("embedding").isNotNull()).where(F.forall(x, finite))
    most = float(2**60)
    whole = F.transform(x, lambda e: F.floor(F.least(F.greatest(e * scale, F.lit(-most)), F.lit(most))))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), label.alias("label"), whole.alias("v"))


class Orchard:
    """Nearest entries of a codebook by its distance-sorted neighbour lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.gaps = ((entries[:, None] - entries[None]) ** 2).sum(2)
        self.lists = np.argsort(self.gaps, axis=1, kind="stable")
        self.by_sum = np.argsort(entries.sum(1), kind="stable")
        self.sums = entries.sum(1)[self.by_sum]

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each point's nearest entry, ties to the smaller number."""
        at = self.by_sum[np.minimum(np.searchsorted(self.sums, points.sum(1)), len(self.sums) - 1)]  # any start will do
        best = ((points - self.entries[at]) ** 2).sum(1)
        live = np.arange(len(points))
        visited = np.zeros((len(points), len(self.entries)), bool)
        visited[live, at] = True
        step = np.zeros(len(points), np.int64)
        while len(live):
            met = self.lists[at[live], step[live]]
            near = (self.gaps[at[live], met] + 3) // 4 <= best[live]  # within twice the distance; in squares, four times
            live, met = live[near], met[near]
            step[live] += 1
            fresh = ~visited[live, met]
            rows, met = live[fresh], met[fresh]
            visited[rows, met] = True
            far = ((points[rows] - self.entries[met]) ** 2).sum(1)
            better = (far < best[rows]) | ((far == best[rows]) & (met < at[rows]))
            jump = rows[better]
            at[jump], best[jump], step[jump] = met[better], far[better], 0
            live = live[step[live] < len(self.entries)]
        return at, best


def _bound(width: int) -> int:
    """Components up to this bound have squared distances over ``width`` components within 62 bits."""
    return 1 << (61 - (width - 1).bit_length()) // 2


def _dense(lists: pa.ListArray, width: int) -> np.ndarray:
    lengths = np.diff(lists.offsets.to_numpy())
    dense = np.zeros((len(lengths), width), np.int64)
    dense[np.arange(width) < lengths[:, None]] = lists.flatten().to_numpy()
    return np.clip(dense, -_bound(width), _bound(width))


def _sums(codebooks: np.ndarray):
    """Per task: component sums and counts of what fell to each entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, entries, per = codebooks.shape
        trees = [Orchard(c) for c in codebooks]
        totals, counts = np.zeros_like(codebooks), np.zeros((parts, entries), np.int64)
        for batch in batches:
            dense = _dense(batch.column(0), parts * per)
            for k, tree in enumerate(trees):
                part = dense[:, k * per : (k + 1) * per]
                code, _ = tree.nearest(part)
                np.add.at(totals[k], code, part)
                counts[k] += np.bincount(code, minlength=entries)
        k, j = np.nonzero(counts)
        place = np.tile(np.arange(per), len(k))
        columns = [np.repeat(k, per), np.repeat(j, per), place]
        arrays = [pa.array(c.astype(np.int32)) for c in columns]
        arrays += [pa.array(totals[k, j].ravel()), pa.array(np.repeat(counts[k, j], per))]
        yield pa.RecordBatch.from_arrays(arrays, [f.split()[0] for f in SUMS.split(", ")])

    return run


def _encode(codebooks: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, _, per = codebooks.shape
        trees = [Orchard(c) for c in codebooks]
        for batch in batches:
            dense = _dense(batch.column(2), parts * per)
            codes, error = np.zeros((len(dense), parts), np.uint8), np.zeros(len(dense), np.int64)
            for k, tree in enumerate(trees):
                codes[:, k], far = tree.nearest(dense[:, k * per : (k + 1) * per])
                error += far
            text = codes.tobytes().hex()
            code = [text[at : at + 2 * parts] for at in range(0, len(text), 2 * parts)]
            columns = [batch.column(0), batch.column(1), pa.array(code, pa.string()), pa.array(error)]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return run


def train(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, component) of rows as :func:`usable` gives; no entries where there are no rows."""
    longest = rows.agg(F.max(F.size("v"))).first()[0] or 0
    per = max(1, -(-longest // parts))
    first = [r["v"] for r in rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    dense = _dense(pa.array(first, pa.list_(pa.int64())), parts * per)
    codebooks = np.ascontiguousarray(dense.reshape(len(dense), parts, per).transpose(1, 0, 2))
    for _ in range(rounds if first else 0):
        sums = rows.select("v").mapInArrow(_sums(codebooks), SUMS).groupBy("part", "entry", "place")
        found = sums.agg(F.sum("total").alias("total"), F.sum("n").alias("n")).collect()  # one row per component at most
        codebooks = codebooks.copy()
        for r in found:
            codebooks[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return codebooks


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, label: Column, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """vec_id, code (two hex digits per part), error, label_error, codebooks_sha256 of every usable row.

    ``label`` is any column that Spark can group by; null labels form one group.
    """
    rows = settle(usable(vectors, label, scale), "vectors")
    codebooks = train(rows, parts, entries, rounds)
    fields = [rows.schema["vec_id"], rows.schema["label"], StructField("code", StringType()), StructField("error", LongType())]
    coded = settle(rows.mapInArrow(_encode(codebooks), StructType(fields)), "codes")
    sums = coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"))
    joined = coded.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", F.expr("try_cast(total AS long)").alias("label_error"), F.lit(digest(codebooks)).alias("codebooks_sha256"))


def query(spark, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"), F.col("label"))


def _oracle() -> str:
    far = "CAST(list_sum(list_transform(list_zip(x.x, c.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT)"
    steps = []
    for k in range(ROUNDS + 1):
        steps.append(f"a{k} AS (SELECT x.r, x.p, min({far} * {ENTRIES} + c.j) AS b FROM x JOIN c{k} c USING (p) GROUP BY ALL)")
        if k < ROUNDS:
            steps.append(
                f"""s{k} AS (SELECT p, b % {ENTRIES} AS j, i, CAST(sum(x.x[i]) AS BIGINT) AS s, count(*) AS n
  FROM a{k} JOIN x USING (r, p), range(1, (SELECT per + 1 FROM w)) t(i) GROUP BY ALL),
f{k} AS (SELECT p, j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM s{k} GROUP BY ALL),
c{k + 1} AS (SELECT o.p, o.j, coalesce(f.c, o.c) AS c FROM c{k} o LEFT JOIN f{k} f USING (p, j))"""
            )
    return f"""
WITH e AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), w AS (
  SELECT greatest(1, CAST(ceil(max(len(v)) / {PARTS}.0) AS BIGINT)) AS per FROM e
), k AS MATERIALIZED (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM e
), x AS MATERIALIZED (
  SELECT r, p, list_slice(list_resize(v, {PARTS} * per, 0), p * per + 1, (p + 1) * per) AS x FROM k, w, range({PARTS}) t(p)
), c0 AS (
  SELECT p, r - 1 AS j, x AS c FROM x WHERE r <= {ENTRIES}
), {", ".join(s.replace(" AS (", " AS MATERIALIZED (", 1) for s in steps)},
g AS (
  SELECT r, string_agg(printf('%02x', b % {ENTRIES}), '' ORDER BY p) AS code, CAST(sum(b // {ENTRIES}) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY r
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, j)) FROM c{ROUNDS}) AS codebooks_sha256
FROM k JOIN g USING (r)
"""


ORACLE = _oracle()
