"""ROUGE scores of (reference, prediction) pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import subsequences
from ..functions.stem import stem_column
from ..functions.text import score_tokens
from ..schema import struct
from .layout import spread_by
from .ranks import settled

NEWLINE = "\n"
#: The same where tokens are numbers of stems.
LINE = -1
SMALL_WORDS = 300_000  # words of a table that is broadcast, some 20 MB
MANY_TOKENS = 500_000  # tokens that a Python task works on at once, whatever the size of an Arrow batch


def _scores(hits: Column, ref_n: Column, pred_n: Column) -> dict[str, Column]:
    zero = F.lit(0.0)
    p, r = F.coalesce(F.try_divide(hits, pred_n), zero), F.coalesce(F.try_divide(hits, ref_n), zero)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), zero)}


def tokenize_pairs(
    pairs: DataFrame, key: str, ref: str = "reference", pred: str = "prediction", stem: bool = False, carry: list[str] = []
) -> DataFrame:
    """(key, carried columns, ref_tokens, pred_tokens); line breaks stay as marker tokens.

    Pairs are spread by key first: moving the texts once is cheaper than moving their grams,
    and every aggregation after it is local. A null text counts as empty. With ``stem`` the tokens become the
    numbers of their stems; a pair was one row before and is one row again.
    """
    texts = spread_by(pairs.select(key, *carry, ref, pred), key)
    tokens = texts.select(
        key,
        *carry,
        score_tokens(F.coalesce(F.col(ref), F.lit(""))).alias("ref_tokens"),
        score_tokens(F.coalesce(F.col(pred), F.lit(""))).alias("pred_tokens"),
    )
    return stem_tokens(tokens, [key, *carry], ["ref_tokens", "pred_tokens"]) if stem else tokens


def _tagged(tokens: Column, side: int) -> Column:
    return F.transform(
        tokens, lambda t, i: F.struct(F.lit(side).alias("side"), i.alias("pos"), t.alias("word"))
    )


def word_table(df: DataFrame, cols: list[str]) -> DataFrame:
    """(word, id) of the words of token-array columns, one id per stem; line breaks have the id ``LINE``.

    Every distinct word is stemmed once. The table is written once, as its numbers must not change between readers.
    """
    words = df.select(F.explode(F.flatten(F.array(*cols))).alias("word")).distinct()
    stems = stem_column(words.where(F.col("word") != NEWLINE), "word", "stem")
    by_stem = stems.groupBy("stem").agg(F.collect_list("word").alias("words")).withColumn("id", F.monotonically_increasing_id())
    line = df.sparkSession.range(1).select(F.lit(NEWLINE).alias("word"), F.lit(LINE).cast("long").alias("id"))
    return settled(by_stem.select(F.explode("words").alias("word"), "id").union(line), "words")


def stem_tokens(df: DataFrame, keys: list[str], cols: list[str], words: DataFrame | None = None) -> DataFrame:
    """Words of token-array columns as numbers of their stems, by the columns' own word table or a wider one; ``keys`` are
    unique per row.

    A word table of up to ``SMALL_WORDS`` words is broadcast, so tokens stay where they are; a larger one is left to the
    join that Spark chooses, which deals words out and splits frequent ones.
    """
    words = word_table(df, cols) if words is None else words
    if words.count() <= SMALL_WORDS:
        words = F.broadcast(words)
    tagged = F.concat(*[_tagged(F.col(c), side) for side, c in enumerate(cols)])
    rows = df.select(*keys, F.explode_outer(tagged).alias("t")).select(*keys, "t.side", "t.pos", "t.word").join(words, "word", "left")
    lists = [
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("side") == side, F.struct("pos", "id")))),
            lambda x: x["id"],
        ).alias(c)
        for side, c in enumerate(cols)
    ]
    return rows.groupBy(*keys).agg(*lists)


def _parts(ref: pa.Array, pred: pa.Array, most: int = MANY_TOKENS) -> Iterator[tuple[pa.Array, pa.Array]]:
    """Runs of pairs of about ``most`` tokens; a longer pair stands alone."""
    upto = sum(x.offsets.to_numpy() - x.offsets[0].as_py() for x in (ref, pred))
    begin = 0
    while begin < len(ref):
        end = max(begin + 1, int(np.searchsorted(upto, upto[begin] + most, "right")) - 1)
        yield ref.slice(begin, end - begin), pred.slice(begin, end - begin)
        begin = end


def _coded(ref: pa.Array, pred: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray], int]:
    """Both sides' tokens as numbers, where each pair's tokens begin, and the number of a line break."""
    line = pa.array([NEWLINE if pa.types.is_string(ref.type.value_type) else LINE], ref.type.value_type)
    coded = pa.concat_arrays([ref.flatten(), pred.flatten(), line]).dictionary_encode().indices.to_numpy().astype(np.int64)
    cuts = [x.offsets.to_numpy() - x.offsets[0].as_py() for x in (ref, pred)]
    return [coded[: cuts[0][-1]], coded[cuts[0][-1] : -1]], cuts, int(coded[-1])


def gram_hits(ref: pa.Array, pred: pa.Array, width: int) -> np.ndarray:
    """Grams that each pair's sides share, counted as often as both have them: a row per pair, a column per order.

    Line breaks are no tokens. The sides are laid end to end with an owner per token, and a gram is the number of the gram
    one shorter and of its last token.
    """
    sides, cuts, line = _coded(ref, pred)
    pairs = len(ref)
    owner = np.concatenate([np.repeat(np.arange(pairs) + k * pairs, np.diff(c)) for k, c in enumerate(cuts)])
    codes = np.concatenate(sides)
    owner, codes = owner[codes != line], codes[codes != line]
    hits = np.zeros((pairs, width), np.int64)
    kinds = int(codes.max(initial=0)) + 1
    gram = codes
    for n in range(1, width + 1):
        if n > 1:
            gram = np.unique(gram[:-1] * kinds + codes[n - 1 :], return_inverse=True)[1]
        if not len(gram):
            break
        whole = owner[: len(gram)] == owner[n - 1 :]
        grams = int(gram.max()) + 1
        of, cell = owner[: len(gram)][whole], (owner[: len(gram)] % pairs * grams + gram)[whole]
        (a, a_n), (b, b_n) = (np.unique(cell[side], return_counts=True) for side in (of < pairs, of >= pairs))
        both, i, j = np.intersect1d(a, b, assume_unique=True, return_indices=True)
        np.add.at(hits[:, n - 1], both // grams, np.minimum(a_n[i], b_n[j]))
    return hits


def _gram_hits(width: int):
    @F.arrow_udf("array<bigint>")
    def hits(ref: pa.Array, pred: pa.Array) -> pa.Array:
        found = np.concatenate([np.zeros((0, width), np.int64), *[gram_hits(a, b, width) for a, b in _parts(ref, pred)]])
        return pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1, dtype=np.int32) * width), pa.array(found.ravel()))

    return hits


def _line(tokens: DataFrame) -> Column:
    return F.lit(LINE).cast("long") if dict(tokens.dtypes)["ref_tokens"] == "array<bigint>" else F.lit(NEWLINE)


def rouge_n(tokens: DataFrame, key: str, ns: tuple[int, ...] = (1, 2), carry: list[str] = []) -> DataFrame:
    """ROUGE-N precision, recall and F1, one row per pair, beside the carried columns.

    The grams of a pair are counted where its token lists are, so they are never shuffled; a side has as many grams of an
    order as its tokens allow.
    """
    sizes = [F.size(F.array_remove(c, _line(tokens))).alias(out) for c, out in (("ref_tokens", "_nr"), ("pred_tokens", "_np"))]
    hits = tokens.select(key, *carry, *sizes, _gram_hits(max(ns))("ref_tokens", "pred_tokens").alias("_hits"))
    out = []
    for n in ns:
        of = [F.greatest(F.col(c) - (n - 1), F.lit(0)) for c in ("_nr", "_np")]
        for stat, c in _scores(F.get("_hits", F.lit(n - 1)), *of).items():
            out.append(c.alias(f"rouge{n}_{stat}"))
    return hits.select(key, *carry, *out)


# --- longest common subsequences (Arrow) --------------------------------------------


def lcs_length(a: list[str], b: list[str]) -> int:
    return len(b) - subsequences.bit_rows(a, b)[-1].bit_count()


def lcs_positions(a: list[str], b: list[str]) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``."""
    return subsequences.positions(a, b)


@F.arrow_udf(struct(l="long", lsum="long"))
def _subsequence_hits(ref: pa.Array, pred: pa.Array) -> pa.Array:
    found: list[list[np.ndarray]] = [[], []]
    for part in _parts(ref, pred):
        sides, cuts, line = _coded(*part)
        for all_, some in zip(found, subsequences.hits((sides[0], cuts[0]), (sides[1], cuts[1]), line), strict=True):
            all_.append(np.asarray(some, np.int64))
    return pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *c])) for c in found], ["l", "lsum"])


def _lcs_scores(tokens: DataFrame, keep: list[str]) -> DataFrame:
    line = _line(tokens)
    n_ref, n_pred = F.size(F.array_remove("ref_tokens", line)), F.size(F.array_remove("pred_tokens", line))
    hits = tokens.select(*keep, n_ref.alias("_nr"), n_pred.alias("_np"), _subsequence_hits("ref_tokens", "pred_tokens").alias("_h"))
    out = []
    for name, c in (("rougeL", F.col("_h.l")), ("rougeLsum", F.col("_h.lsum"))):
        for stat, score in _scores(c, F.col("_nr"), F.col("_np")).items():
            out.append(score.alias(f"{name}_{stat}"))
    return hits.select(*keep, *out)


def rouge_l(tokens: DataFrame, key: str) -> DataFrame:
    """ROUGE-L and ROUGE-Lsum precision, recall and F1, one row per pair; no shuffle."""
    return _lcs_scores(tokens, [key])


def f1_scores(
    pairs: DataFrame, key: str, ref: str = "reference", pred: str = "prediction",
    stem: bool = True, lcs: bool = True, carry: list[str] = [],
) -> DataFrame:
    """F1 of every score per pair (``rouge1_f1`` ..) in one flow without joins."""
    return token_f1_scores(tokenize_pairs(pairs, key, ref, pred, stem, carry), key, lcs, carry)


def token_f1_scores(tokens: DataFrame, key: str, lcs: bool = True, carry: list[str] = []) -> DataFrame:
    """F1 of every score per row of ``ref_tokens`` and ``pred_tokens``; no shuffle."""
    extra = []
    if lcs:
        extra = ["rougeL_f1", "rougeLsum_f1"]
        kept = [key, *carry, "ref_tokens", "pred_tokens"]
        tokens = _lcs_scores(tokens, kept).select(*kept, *extra)
    return rouge_n(tokens, key, carry=[*carry, *extra]).select(key, *carry, "rouge1_f1", "rouge2_f1", *extra)
