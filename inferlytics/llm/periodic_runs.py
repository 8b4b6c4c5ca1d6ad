"""Periodic runs in word sequences by an online sparse dynamic programme over diagonals.

The diagonal of lag q holds, for each word, whether it equals the word q before it; a run of period q is a long enough
stretch of such matches. Word by word, an earlier occurrence at lag q lengthens the match that is active on diagonal q, and
a diagonal that is not carried on ends: if it was long enough its run is emitted there and then.

What keeps it sparse: a run is at least four periods long. For lags over k/2 and up to k (k = 1, 2, 4, ...) only that
earlier occurrence of a word counts from which on the next k words are the same too, and of those only the nearest. Inside a
run of smallest period q every word but those of the last k and the first q has its nearest such occurrence exactly at lag
q (a nearer one would give the run a smaller period), and a stretch of nearest occurrences at lag q, long enough, is a run
whole: it can neither be carried on nor have a smaller period. So each k has one active diagonal at a time, n words cost
n log n steps whatever they are, and the result is exact. Words followed by k words that do not repeat in their document
are left out from k on, which is most of ordinary text.

Documents are handled where they lie, many at a time; nothing is shuffled. Odd input: a null text has no words; a null
doc_id is kept (and never rewritten). Empty texts have no runs. Repeated rows are returned as often as they occur. Very
long texts are handled whole, with memory in proportion to their words. An empty table gives an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferlytics.llm.common import table

LEAST = 6  # words of a run at least
PERIODS = 4  # periods of a run at least
SLICE = 4_000_000  # bytes of text handled together
FOUND = "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
Rewrite = Callable[[int, int], tuple[int, int] | None]


def emitted(at: np.ndarray, lag: np.ndarray, span: int) -> Iterator[tuple[int, int, int]]:
    """(start, length, period) of the runs among occurrences, by position: the word at ``at`` and those up to ``span`` words
    from it equal the words ``lag`` before them."""
    active = following = matched = 0

    def run() -> tuple[int, int, int]:
        length = matched + span - 1 + active
        return following + span - 1 - length, length, active

    for position, q in zip(at.tolist(), lag.tolist(), strict=True):
        if q == active and position == following:
            matched += 1
        else:
            if active and matched + span - 1 + active >= max(LEAST, PERIODS * active):
                yield run()
            active, matched = q, 1
        following = position + 1
    if active and matched + span - 1 + active >= max(LEAST, PERIODS * active):
        yield run()


def runs_of(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows (start, length, period) by start, then period; ``words``: numbers of the words of documents that follow one
    another, ``bounds``: where each begins, and the end."""
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    at = np.flatnonzero(sizes[doc] >= LEAST)
    key = doc[at] * (int(words.max(initial=0)) + 1) + words[at]
    found: list[tuple[int, int, int]] = []
    span = 1
    while len(at):
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        same = ranked[1:] == ranked[:-1]
        later, earlier = order[1:][same], order[:-1][same]
        lag = np.zeros(len(at), np.int64)
        lag[later] = at[later] - at[earlier]
        near = np.flatnonzero((lag > span // 2) & (lag <= span))
        found += emitted(at[near], lag[near], span)
        gram = np.empty(len(at), np.int64)
        gram[order] = np.concatenate([[0], np.cumsum(~same)])
        again = np.zeros(len(at), bool)
        again[later] = again[earlier] = True
        again &= sizes[doc[at]] > PERIODS * span  # the next lags are over span
        at, gram = at[again], gram[again]
        other = np.minimum(np.searchsorted(at, at + span), max(len(at) - 1, 0))
        whole = (at[other] == at + span) & (doc[at[other]] == doc[at])
        key = gram[whole] * (len(words) + 1) + gram[other[whole]]
        at = at[whole]
        span *= 2
    return np.array(sorted(found, key=lambda r: (r[0], r[2])), np.int64).reshape(-1, 3)


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` bytes; a longer row is one of its own or ends one."""
    group = (np.cumsum(sizes) - 1) // SLICE
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from zip(cuts, cuts[1:], strict=False)


def _found(rewrite: Rewrite | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(pc.binary_length(batch.column(1)).to_numpy()):
                part = batch.slice(a, b - a)
                yield _handle(part.column(0), part.column(1), rewrite)

    return run


def _handle(ids: pa.Array, texts: pa.Array, rewrite: Rewrite | None) -> pa.RecordBatch:
    lists = pc.ascii_split_whitespace(texts)
    flat = lists.flatten()
    real = pc.not_equal(flat, "")  # white space at either end leaves an empty word there
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    bounds = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])[offsets]
    coded = flat.filter(real).dictionary_encode()
    words = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if rewrite:
        source = np.arange(len(words))
        for k, doc_id in enumerate(ids.to_pylist()):
            n = int(bounds[k + 1] - bounds[k])
            if n and doc_id is not None and (cycle := rewrite(doc_id, n)):
                first, period = cycle
                begin = int(bounds[k]) + first
                source[begin : bounds[k + 1]] = begin + np.arange(n - first) % period
        words = words[source]
    runs = runs_of(words, bounds)
    cover = np.zeros(len(words) + 1, np.int64)
    np.add.at(cover, runs[:, 0] + runs[:, 2], 1)
    np.add.at(cover, runs[:, 0] + runs[:, 1], -1)
    kept = np.cumsum(cover)[:-1] == 0
    ends = np.concatenate([[0], np.cumsum(kept)])[bounds]
    collapsed = pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), coded.dictionary.take(pa.array(words[kept]))), " ")
    each = np.searchsorted(runs[:, 0], bounds)
    start = runs[:, 0] - bounds[np.searchsorted(bounds, runs[:, 0], "right") - 1]
    structs = pa.StructArray.from_arrays([pa.array(c) for c in (start, runs[:, 1], runs[:, 2])], ["start", "length", "period"])
    columns = [ids, pa.array(np.diff(bounds)), pa.ListArray.from_arrays(pa.array(each, pa.int32()), structs), collapsed]
    return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in ("doc_id", "n_words", "runs", "collapsed")])


def find_runs(docs: DataFrame, rewrite: Rewrite | None = None) -> DataFrame:
    """doc_id, n_words, runs (start word, length, period; by start, then period) and the text without the repeated part of
    each run, words joined by one space.

    ``rewrite`` (doc_id, n) may give (a, p): from word a on the document repeats the p words there. It is for planting
    runs, whose detection can then be measured.
    """
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).mapInArrow(_found(rewrite), FOUND)


def planted(doc_id: int, n: int) -> tuple[int, int] | None:
    """Every tenth document, by its id's checksum, repeats a cycle from some word on."""
    h = zlib.crc32(str(doc_id).encode())
    g = h // 10
    a = g % n
    return (a, 1 + (n - a) // (3 + g % 8)) if h % 10 == 0 else None


def _strongest(runs: Column) -> Column:
    """The first run of the greatest length / period, compared without division."""

    def better(best: Column, run: Column) -> Column:
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), better)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_runs(table(spark, sf_dir, "documents"), planted).withColumn("best", _strongest(F.col("runs")))
    line = F.transform("runs", lambda r: F.concat_ws(",", *[r[f].cast("string") for f in ("start", "length", "period")]))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(line, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


ORACLE = """
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), h AS (
  SELECT *, len(ws) AS n, xor(4294967295, list_reduce(
    list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT)),
    lambda s, b: list_reduce([0, 1, 2, 3, 4, 5, 6, 7], lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, xor(s, b)),
    4294967295)) AS h
  FROM w
), g AS (
  SELECT *, CASE WHEN h % 10 = 0 AND n > 0 THEN (h // 10) % n ELSE n END AS a, 3 + (h // 10) % 8 AS k FROM h
), d AS (
  SELECT r, doc_id, n, i, CASE WHEN i >= a THEN ws[1 + a + (i - a) % (1 + (n - a) // k)] ELSE ws[1 + i] END AS word
  FROM g, range(n) t(i)
), m AS (
  SELECT x.r, x.i, x.i - y.i AS q FROM d x JOIN d y ON x.r = y.r AND x.word = y.word AND y.i < x.i AND 4 * (x.i - y.i) <= x.n
), s AS (
  SELECT r, q, min(i) - q AS start, count(*) + q AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY r, q ORDER BY i) AS island FROM m) GROUP BY r, q, island
), u AS (
  SELECT r, start, length, min(q) AS q FROM s WHERE length >= greatest(6, 4 * q) GROUP BY r, start, length
), p AS (
  SELECT r, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines FROM u GROUP BY r
), best AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY length // q DESC, (length % q) / q DESC, start, q) AS place FROM u
), c AS (
  SELECT r, string_agg(word, ' ' ORDER BY i) AS words FROM d
  WHERE NOT EXISTS (FROM u WHERE u.r = d.r AND d.i >= u.start + u.q AND d.i < u.start + u.length) GROUP BY r
)
SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, start, length, q AS period, 1000 * length // q AS exponent_milli,
  sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(words, '')) AS collapsed_sha256
FROM w LEFT JOIN p USING (r) LEFT JOIN (FROM best WHERE place = 1) b USING (r) LEFT JOIN c USING (r)
"""
