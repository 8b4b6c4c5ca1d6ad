"""Model output scoring: id decoding, pairing with references, corpus figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.text import score_tokens
from .filters import vocabulary_filter
from .rouge import f1_scores, stem_tokens, token_f1_scores, word_table

SMALL_VOCABULARY = 1_000_000  # ids; their pieces are one array of some MB
SCORES = ["rouge1", "rouge2", "rougeL", "rougeLsum"]


def decode_hex_ids(df: DataFrame, col: str = "data", vocab_size: int | None = None, out: str = "token_ids") -> DataFrame:
    """Add the int32 ids of a hex column, limited to the vocabulary if its size is given."""
    ids = tx.hex_ids(F.col(col))
    return df.withColumn(out, ids if vocab_size is None else vocabulary_filter(ids, vocab_size))


def malformed_hex(df: DataFrame, col: str = "data") -> DataFrame:
    """Rows whose hex text is not a whole number of int32 values."""
    return df.where(F.col(col).isNotNull() & tx.hex_ids(F.col(col)).isNull())


def pair_predictions(log: DataFrame, refs: DataFrame, dedupe_references: bool = False, order: str = "log_id") -> DataFrame:
    """Predictions with their reference row by index.

    Indices past the end and below zero find no partner. Repeated indices are all kept;
    with ``dedupe_references`` only the first log row (by ``order``) of each reference text.
    """
    paired = log.join(refs, F.col("qsl_idx") == F.col("sample_idx"), "inner").drop("sample_idx")
    if not dedupe_references:
        return paired
    first = paired.groupBy("reference").agg(F.min(order).alias("_first"))
    return paired.join(first.drop("reference"), F.col(order) == F.col("_first"), "left_semi")


def decode_tokens(
    df: DataFrame, vocab: DataFrame, key: str, ids: str = "token_ids", sep: str = "", out: str = "text", vocab_size: int | None = None,
    carry: list[str] = [],
) -> DataFrame:
    """Text of each id list: pieces in order, special pieces and unknown ids left out.

    ``vocab`` is (token_id, piece, special), ids unique. Returns (key, carried columns, text, n_tokens); ``key`` is unique. With a
    ``vocab_size`` of up to ``SMALL_VOCABULARY`` ids the pieces are one array, looked up by position where the lists are;
    otherwise the tokens meet the vocabulary in a join.
    """
    pieces = vocab.where(~F.col("special")).select("token_id", "piece")
    if vocab_size is not None and vocab_size <= SMALL_VOCABULARY:
        every = df.sparkSession.range(vocab_size + 1).join(pieces, F.col("id") == F.col("token_id"), "left")
        by_id = F.transform(F.sort_array(F.collect_list(F.struct("id", "piece"))), lambda x: x["piece"])
        known = every.agg(by_id.alias("known")).scalar()
        listed = F.coalesce(ids, F.array().cast("array<int>"))
        rows = df.select(key, *carry, listed.alias("_ids"), known.alias("_known"))
        text = F.array_join(F.transform("_ids", lambda t: F.get("_known", t)), sep)
        return rows.select(key, *carry, text.alias(out), F.size(F.array_compact("_ids")).cast("long").alias("n_tokens"))
    rows = df.select(key, *carry, F.posexplode_outer(ids).alias("pos", "token_id"))
    found = rows.join(pieces, "token_id", "left")
    ordered = F.sort_array(F.collect_list(F.when(F.col("piece").isNotNull(), F.struct("pos", "piece"))))
    return found.groupBy(key, *carry).agg(
        F.concat_ws(sep, F.transform(ordered, lambda x: x["piece"])).alias(out),
        F.count("token_id").alias("n_tokens"),
    )


def normalize_sentences(df: DataFrame, cols: list[str]) -> DataFrame:
    """One sentence per line in the named text columns."""
    return df.withColumns({c: tx.sentence_lines(F.col(c)) for c in cols})


def _percent(c: Column) -> Column:
    return F.bround(c * 100, 4)


def percent_columns(scores: DataFrame) -> list[Column]:
    """The F1 scores of a table in percent."""
    return [_percent(F.col(f"{n}_f1")).alias(n) for n in SCORES if f"{n}_f1" in scores.columns]


def sample_scores(
    pairs: DataFrame, key: str = "pair_id", ref: str = "reference", pred: str = "prediction",
    n_tokens: str = "n_tokens", stem: bool = True, lcs: bool = True,
) -> DataFrame:
    """Per pair: unrounded F1 scores, characters and tokens of the prediction; all that the corpus record needs."""
    sized = pairs.withColumns({"_chars": F.coalesce(F.length(pred), F.lit(0)), "_tokens": F.col(n_tokens)})
    return f1_scores(sized, key, ref, pred, stem, lcs, ["_chars", "_tokens"])


def scores_by_reference(
    samples: DataFrame, targets: DataFrame, key: str, carry: list[str], stem: bool = True, lcs: bool = True
) -> DataFrame:
    """As :func:`sample_scores`, for samples (key, qsl_idx, prediction, n_tokens) and targets (sample_idx, target).

    A reference may have many samples: it is cut into tokens and stemmed once, and its token list meets the predictions'.
    """
    ref = targets.select("sample_idx", score_tokens(F.coalesce("target", F.lit(""))).alias("ref_tokens"))
    sized = samples.withColumns({"_chars": F.coalesce(F.length("prediction"), F.lit(0)), "_tokens": F.col("n_tokens")})
    kept = [*carry, "_chars", "_tokens"]
    pred = sized.select(key, "qsl_idx", *kept, score_tokens(F.coalesce("prediction", F.lit(""))).alias("pred_tokens"))
    if stem:
        both = ref.select(F.col("ref_tokens").alias("_t")).union(pred.select("pred_tokens"))
        words = word_table(both, ["_t"])
        ref = stem_tokens(ref, ["sample_idx"], ["ref_tokens"], words)
        numbers = stem_tokens(pred.select(key, "pred_tokens"), [key], ["pred_tokens"], words)
        pred = pred.drop("pred_tokens").join(numbers, key)
    tokens = pred.join(ref, F.col("qsl_idx") == F.col("sample_idx")).drop("sample_idx")
    return token_f1_scores(tokens, key, lcs, ["qsl_idx", *kept])


def with_scores(pairs: DataFrame, scores: DataFrame, key: str, keep: list[str] | None = None) -> DataFrame:
    """Columns of the pairs with their F1 scores in percent."""
    rounded = scores.select(key, *percent_columns(scores))
    return pairs.select(key, *[c for c in (keep or pairs.columns) if c != key]).join(rounded, key)


def corpus_record(scores: DataFrame) -> DataFrame:
    """One record: mean scores, generated characters, samples, tokens, tokens per sample.

    Without pairs the record carries an error text and zeros.
    """
    names = [n for n in SCORES if f"{n}_f1" in scores.columns]
    record = scores.agg(
        *[_percent(F.avg(f"{n}_f1")).alias(n) for n in names],
        F.coalesce(F.sum("_chars"), F.lit(0)).cast("long").alias("gen_len"),
        F.count(F.lit(1)).alias("gen_num"),
        F.coalesce(F.sum("_tokens"), F.lit(0)).cast("long").alias("gen_tok_len"),
    )
    return record.select(
        "*",
        F.coalesce(F.bround(F.try_divide(F.col("gen_tok_len"), F.col("gen_num")), 1), F.lit(0.0)).alias("tokens_per_sample"),
        F.when(F.col("gen_num") == 0, F.lit("No valid samples")).alias("error"),
    )


def score_samples(
    pairs: DataFrame, key: str = "pair_id", ref: str = "reference", pred: str = "prediction",
    stem: bool = True, lcs: bool = True, keep: list[str] | None = None,
) -> DataFrame:
    """Per-pair F1 scores in percent beside the columns of the pair."""
    return with_scores(pairs, f1_scores(pairs, key, ref, pred, stem, lcs), key, keep)


def corpus_accuracy(
    pairs: DataFrame, key: str = "pair_id", ref: str = "reference", pred: str = "prediction",
    n_tokens: str = "n_tokens", stem: bool = True, lcs: bool = True,
) -> DataFrame:
    """The corpus record of pairs of sentence-form texts; lengths and token counts are carried through the scoring."""
    return corpus_record(sample_scores(pairs, key, ref, pred, n_tokens, stem, lcs))
