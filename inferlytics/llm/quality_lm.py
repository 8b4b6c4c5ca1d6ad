"""Quality classifier: character n-gram model with interpolated modified Kneser-Ney smoothing.

Training counts, their contexts and the grams that the corpus asks for are tables keyed by gram and joined by key, so
every part is sharded. Documents are packed into blocks of about ``BLOCK_CHARS`` characters; a block asks once for each
distinct gram, the joins answer with log probabilities, and the block scores its documents from the answers. So the
shuffle carries distinct grams per block and compressed blocks, not one row for each gram of each text.

Nulls and odd input: a null text counts as empty, an empty text has one event (its end); a null language is the language
''. Repeated rows are scored one by one. Without trusted documents in both folds nothing is rejected. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferlytics.llm.common import DOCUMENTS, beside_texts, keep_rows, only, settle, table, text_key

ORDER = 4
SALTS = 64  # a language's bar stands so many times
BITS = 12  # a symbol is a code point folded into 12 bits, so four of them fit into a long
BLOCK_CHARS = 16_000_000
CHUNK_CHARS = 2_000_000
TRUSTED_IDS = 5_000_000  # ids that are sent to every executor; a lone long takes less than a key of two columns
FOLDS = 2  # each half of the trusted documents is scored by the model of the other half
QUANTILE = 0.997  # share of a language's trusted documents that lies below its threshold
PRIOR = 100  # events at the language's mean that are added to each text, so that short texts lie near the mean
STEP = 1e-4  # width of the bins in which scores are counted
PAD, END = 0, 1
SCORES = "doc_id long, text_key long, lang string, events long, nll double"


def _symbols() -> np.ndarray:
    cps = np.arange(0x110000)
    table_ = np.where(cps < 4096, cps, 2048 + cps % 2048)
    table_[:32] = 32  # controls and line ends count as a space
    table_[48:58] = 48  # any digit
    return table_.astype(np.uint64)


_SYMBOLS: np.ndarray | None = None


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams, one per character and text end, and where each text's grams begin (one more for the end)."""
    global _SYMBOLS
    if _SYMBOLS is None:
        _SYMBOLS = _symbols()
    pad = order - 1
    sizes = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(sizes + order)])
    codes = np.frombuffer("".join("\0" * pad + t + "\0" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    symbols = _SYMBOLS[codes]
    for k in range(pad):
        symbols[begins[:-1] + k] = PAD
    symbols[begins[1:] - 1] = END
    packed = symbols[pad:].copy()
    for k in range(1, order):
        packed |= symbols[pad - k : len(symbols) - k] << np.uint64(BITS * k)
    real = np.ones(len(packed), bool)
    for k in range(pad):
        real[begins[1:-1] - pad + k] = False
    return packed[real].astype(np.int64), np.concatenate([[0], np.cumsum(sizes + 1)])


def _pieces(texts: list[str]) -> Iterator[list[str]]:
    """Runs of texts of about ``CHUNK_CHARS`` characters."""
    run: list[str] = []
    size = 0
    for text in texts:
        if run and size + len(text) > CHUNK_CHARS:
            yield run
            run, size = [], 0
        run.append(text)
        size += len(text)
    if run:
        yield run


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple[int | None, int, str, str]]]]:
    """Consecutive rows of a task as blocks. A block's id is a hash of its rows, so equal blocks have equal ids wherever
    and however often they are built."""
    rows: list[tuple[int | None, int, str, str]] = []
    size = 0
    for batch in batches:
        for row in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            if rows and size + len(row[3]) > BLOCK_CHARS:
                yield _block_id(rows), rows
                rows, size = [], 0
            rows.append(row)
            size += len(row[3])
    if rows:
        yield _block_id(rows), rows


def _block_id(rows: list[tuple[int | None, int, str, str]]) -> int:
    import xxhash

    digest = xxhash.xxh64()
    for doc_id, key, lang, _ in rows:
        digest.update(f"{doc_id}:{key}:{lang};".encode())
    return digest.intdigest() - (1 << 63)


def _count_grams(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in _pieces(batch.column(0).to_pylist()):
                key, n = np.unique(grams(texts, order)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], ["gram", "n"])

    return run


def _ask(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, rows in _blocks(batches):
            parts = [np.unique(grams(texts, order)[0]) for texts in _pieces([r[3] for r in rows])]
            key = np.unique(np.concatenate(parts))
            for at in range(0, len(key), 50_000):
                some = key[at : at + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), block)), pa.array(some)], ["block", "gram"])

    return run


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "text_key", "lang", "text"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.large_string()]
    for block, rows in _blocks(batches):
        columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, pa.schema(list(zip(names, types, strict=True)))) as stream:
            stream.write_batch(pa.RecordBatch.from_arrays(columns, names))
        payload = zstandard.compress(sink.getvalue().to_pybytes(), 3)
        yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([payload], pa.binary())], ["block", "payload"])


def _score(order: int):
    def run(blocks: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        found = answers["gram"].to_numpy()
        by = np.argsort(found)
        found, logp = found[by], answers["logp"].to_numpy()[by]
        out = []
        for payload in blocks["payload"]:
            stored = pa.ipc.open_stream(zstandard.decompress(payload)).read_all()
            texts = stored.column("text").to_pylist()
            nll = []
            for run_ in _pieces(texts):
                key, begins = grams(run_, order)
                at = np.minimum(np.searchsorted(found, key), max(len(found) - 1, 0))
                if not len(found) or not (found[at] == key).all():
                    raise RuntimeError("a block was packed from other rows than it asked for: settle the input first")
                nll.append(-np.add.reduceat(logp[at], begins[:-1]))
            frame = stored.drop_columns(["text"]).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            out.append(frame.assign(events=[len(t) + 1 for t in texts], nll=np.concatenate(nll)))
        columns = ["doc_id", "text_key", "lang", "events", "nll"]
        return pd.concat(out)[columns] if out else pd.DataFrame({c: [] for c in columns})

    return run


def trusted(labels: DataFrame) -> DataFrame:
    """Ids of documents labelled good and not toxic."""
    return labels.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()


def trusted_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, lang, text, fold) of all trusted documents, in folds by a hash of the id; written once, since its readers
    must see the same rows in the same order. The ids go to the texts (see :func:`beside_texts`)."""
    rows = docs.select("doc_id", "lang", "text").join(beside_texts(trusted(labels), "trusted-ids", TRUSTED_IDS), "doc_id", "left_semi")
    return settle(rows.withColumn("fold", F.pmod(F.xxhash64("doc_id"), F.lit(FOLDS)).cast("int")), "trusted")


def text_counts(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over all texts."""
    texts = docs.where(F.col("text").isNotNull()).select("text")
    counted = texts.mapInArrow(_count_grams(order), "gram long, n long")
    return counted.groupBy("gram").agg(F.sum("n").alias("n"))


def training_counts(docs: DataFrame, ids: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, n) over the documents named by ``ids``."""
    return text_counts(docs.join(ids, "doc_id", "left_semi"), order)


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of one order from its counts of counts."""
    row = counts.agg(*[F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in (1, 2, 3, 4))
    if not (n1 and n2):
        return 0.5, 0.5, 0.5
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 1.0)
    return tuple(min(max(d, 0.0), k * 0.999) for k, d in enumerate(raw, 1))  # type: ignore[return-value]


def _discount(d: tuple[float, float, float]):
    n = F.col("n")
    return F.when(n == 1, d[0]).when(n == 2, d[1]).when(n >= 3, d[2]).otherwise(0.0)


def gram_probabilities(asked: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, logp) of each distinct asked gram, from one join per order with the counts and one with the contexts.

    The lower orders count in how many ways a gram is continued to the left. An unseen context leaves the lower
    order's probability as it is; the lowest order rests on an even share for each seen symbol and one unseen one.
    """
    levels = {order: counts}
    for k in range(order - 1, 0, -1):
        suffix = F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1))
        levels[k] = levels[k + 1].groupBy(suffix.alias("gram")).agg(F.count("*").alias("n"))
    rows = asked.withColumn("p", F.lit(None).cast("double"))
    for k in range(1, order + 1):
        level = settle(levels[k], f"grams{k}")
        d = discounts(level)
        contexts = (
            level.groupBy(F.shiftright("gram", BITS).alias("context"))
            .agg(F.sum("n").alias("total"), F.sum(_discount(d)).alias("spare"), F.count("*").alias("kinds"))
        )
        seen = level.select(F.col("gram").alias("part"), (F.col("n") - _discount(d)).alias("above"))
        rows = rows.withColumn("part", F.col("gram").bitwiseAND(F.lit((1 << BITS * k) - 1)))
        rows = rows.join(seen, "part", "left").withColumn("context", F.shiftright("part", BITS))
        rows = rows.join(contexts, "context", "left")
        lower = F.col("p") if k > 1 else F.lit(1.0) / (F.coalesce("kinds", F.lit(0)) + 1)
        p = (F.coalesce("above", F.lit(0.0)) + F.col("spare") * lower) / F.col("total")
        rows = rows.select("gram", F.coalesce(p, lower).alias("p"))
    return rows.select("gram", F.log(F.greatest("p", F.lit(1e-12))).alias("logp"))


def score(docs: DataFrame, counts: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, text_key, lang, events, nll (negative log likelihood of the whole text) of every row."""
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        text_key(F.col("text")).alias("text_key"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    asked = settle(rows.mapInArrow(_ask(order), "block long, gram long"), "asked")
    known = gram_probabilities(asked.select("gram").distinct(), counts, order)
    answers = asked.join(known, "gram").select("block", "gram", "logp")
    packed = rows.mapInArrow(_pack, "block long, payload binary")
    return packed.groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(_score(order), SCORES)


def thresholds(good: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """(lang, middle, bar): mean and threshold over the trusted documents' scores of each language, in nats per event.

    The row with a null language holds the values over all languages, for languages without trusted documents. Scores
    are counted in bins of ``STEP``, combined before the shuffle; the bar is the upper edge of the bin that holds the
    quantile, so ties share one verdict.
    """
    both = good.select(F.explode(F.array("lang", F.lit(None).cast("string"))).alias("lang"), "nll", "events")
    means = both.groupBy(F.col("lang").alias("of")).agg((F.sum("nll") / F.sum("events")).alias("middle"))
    placed = both.join(means, F.col("lang").eqNullSafe(F.col("of"))).select(
        "lang", "middle", F.ceil(((F.col("nll") + PRIOR * F.col("middle")) / (F.col("events") + PRIOR)) / STEP).alias("bin")
    )
    bins = placed.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.first("middle").alias("middle"))
    so_far = Window.partitionBy("lang").orderBy("bin")
    reached = bins.withColumn("below", F.sum("n").over(so_far)).withColumn("all", F.sum("n").over(Window.partitionBy("lang")))
    return (
        reached.where(F.col("below") >= F.col("all") * quantile)
        .groupBy("lang")
        .agg(F.first("middle").alias("middle"), (F.min("bin") * STEP).alias("bar"))
    )


def model(docs: DataFrame, labels: DataFrame, order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """Counts of all trusted documents, and scores of all trusted documents for the thresholds.

    A model knows its own training texts too well for a threshold, so each fold is scored by the counts of the other
    folds. Without counts in some other fold there is no such score.
    """
    good = trusted_rows(docs, labels)
    parts = [settle(text_counts(good.where(F.col("fold") == k), order), f"counts{k}") for k in range(FOLDS)]
    counts = settle(reduce(DataFrame.union, parts).groupBy("gram").agg(F.sum("n").alias("n")), "counts")
    if any(p.isEmpty() for p in parts):
        return counts, score(good.limit(0), counts, order)
    held = []
    for k in range(FOLDS):
        others = reduce(DataFrame.union, [p for i, p in enumerate(parts) if i != k]).groupBy("gram").agg(F.sum("n").alias("n"))
        held.append(score(good.where(F.col("fold") == k), others, order))
    return counts, settle(reduce(DataFrame.union, held), "held-scores")


def classify(docs: DataFrame, labels: DataFrame, order: int = ORDER, quantile: float = QUANTILE) -> DataFrame:
    """Perplexity of every document against all trusted text, its language's threshold and the verdict.

    doc_id, text_key, lang, events, perplexity, threshold, kept; perplexity is over the text's own events, the verdict
    compares the shrunk score (see ``PRIOR``) with the language's bar. Null thresholds (no trusted document at all, or
    none but in one fold) keep.
    """
    counts, good = model(docs, labels, order)
    scores = settle(score(docs, counts, order), "scores")
    bars = thresholds(good, quantile)
    bars = settle(bars, "bars")
    overall = bars.where(F.col("lang").isNull()).first() or (None, None, None)
    langs = scores.select("lang").distinct().join(bars.where(F.col("lang").isNotNull()), "lang", "left").select(
        "lang", *[F.coalesce(name, F.lit(value).cast("double")).alias(name) for name, value in zip(("middle", "bar"), overall[1:])]
    )
    shrunk = (F.col("nll") + PRIOR * F.col("middle")) / (F.col("events") + PRIOR)
    # a language may hold most rows, so its bar stands beside each of its salts
    copies = langs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = scores.withColumn("salt", F.pmod("text_key", F.lit(SALTS)).cast("int"))
    return salted.join(copies, ["lang", "salt"], "left").select(
        "doc_id",
        "text_key",
        "lang",
        "events",
        F.exp(F.col("nll") / F.col("events")).alias("perplexity"),
        F.exp("bar").alias("threshold"),
        F.coalesce(F.ceil(shrunk / STEP) * STEP <= F.col("bar"), F.lit(True)).alias("kept"),
    )


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps, with their columns."""
    verdicts = classify(docs, table(spark, sf_dir, "labels"))
    return keep_rows(only(docs, DOCUMENTS), verdicts.where(~F.col("kept")), "left_anti")


def query(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_key")
