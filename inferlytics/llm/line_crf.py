"""Quality rules by line sequence labelling: a linear-chain conditional random field marks each line as content or
boilerplate, and the share of a text's word characters in content lines decides on the document.

The field has one weight per line feature and label and one per pair of neighbouring labels. It is trained by maximum
likelihood (forward-backward gradients) on lines of about ``TRAIN_ROWS`` labelled documents of at most ``TRAIN_CHARS``
characters, chosen by a hash of the id: lines of good documents are content, lines of bad ones boilerplate, and so are
repeated lines. Decoding is Viterbi over all lines of every whole text. Weights are a fixed small table sent to each task.

Words are runs without ASCII white space. Nulls and odd input: a null or empty text has no words and fails the base rules;
a text without labelled neighbours is judged all the same. Without any labelled document the verdict is that of the base
rules. Repeated rows are judged one by one. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inferlytics.llm.common import table

LEAST_WORDS = 50
TRAIN_ROWS = 2_000  # documented bounds of the labelled sample
TRAIN_CHARS = 20_000
WINDOW = 64  # lines per training sequence
STEPS = 60
SHARE = 0.5
LEAN = 0.75  # added to the content score of each line: a clean document lost costs more than a bad one kept
SYMBOLS = b"#*$%&|<>"
TOGETHER = 1_000_000  # characters per numpy pass

# line features: a bucket of each measure
CUTS = {
    "words": [1, 3, 8, 20, 60],
    "letters": [3, 5, 7, 10],  # characters per word
    "symbols": [0.001, 0.03, 0.1, 0.2],
    "capitals": [0.001, 0.05, 0.2, 0.5],
    "marks": [0.001, 0.03, 0.1],  # exclamation and question marks
    "digits": [0.001, 0.1, 0.3],
    "repeats": [0.001, 0.1, 0.3],  # words equal to the word before
    "again": [0.5],  # the line occurred earlier in the text
}
SIZES = [len(c) + 1 for c in CUTS.values()]
OFFSETS = np.cumsum([0, *SIZES[:-1]])
N_FEATURES = sum(SIZES)


def _classes() -> dict[str, np.ndarray]:
    codes = np.arange(256)
    white = np.isin(codes, [9, 10, 11, 12, 13, 32])
    return {
        "white": white,
        "starts": (codes & 0xC0) != 0x80,  # first byte of a character
        "symbols": np.isin(codes, list(SYMBOLS)),
        "capitals": (codes >= 65) & (codes <= 90),
        "marks": np.isin(codes, list(b"!?")),
        "digits": (codes >= 48) & (codes <= 57),
    }


CLASSES = _classes()


def measure(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For texts together: documents' base measures (n, 5), first line of each document (n + 1), line features (one bucket
    index per measure) and word characters per line."""
    coded = [t.encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(coded) + b"\n", np.uint8)
    ends = np.flatnonzero(data == 10)
    begins = np.concatenate([[0], ends[:-1] + 1])
    split = [t.split(b"\n") for t in coded]
    first = np.concatenate([[0], np.cumsum([len(x) for x in split])])
    white = CLASSES["white"][data]
    opens = ~white & np.concatenate([[True], white[:-1]])

    def per_line(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return sums[ends] - sums[begins]

    words, characters = per_line(opens), per_line(CLASSES["starts"][data] & ~white)
    counted = {name: per_line(CLASSES[name][data]) for name in ("symbols", "capitals", "marks", "digits")}
    again = np.zeros(len(ends), bool)
    at = 0
    for lines in split:
        seen: set[bytes] = set()
        for line in lines:
            if line in seen:
                again[at] = True
            else:
                seen.add(line)
            at += 1
    again &= words > 0
    codes = _word_codes(coded)
    total = np.add.reduceat(words, first[:-1])
    same = np.concatenate([[False], codes[1:] == codes[:-1]])
    of_line = np.repeat(np.arange(len(words)), words)
    same[1:] &= of_line[1:] == of_line[:-1]
    repeats = np.bincount(of_line, same, minlength=len(words))
    base = np.stack(
        [
            total,
            np.add.reduceat(characters, first[:-1]),
            np.add.reduceat(counted["symbols"], first[:-1]),
            np.add.reduceat(again.astype(np.int64), first[:-1]),
            _window_words(codes, total),
        ],
        axis=1,
    )
    some = np.maximum(characters, 1)
    measures = {
        "words": words,
        "letters": characters / np.maximum(words, 1),
        **{name: n / some for name, n in counted.items()},
        "repeats": repeats / np.maximum(words, 1),
        "again": again,
    }
    features = np.stack([np.searchsorted(cuts, measures[name], "right") for name, cuts in CUTS.items()], axis=1) + OFFSETS
    return base, first, features, characters


def _word_codes(texts: list[bytes]) -> np.ndarray:
    """A number for each word of the texts, equal for equal words."""
    words = pc.ascii_split_whitespace(pa.array([b" ".join(texts).decode("utf-8", "surrogatepass")], pa.large_string())).flatten()
    words = words.filter(pc.not_equal(words, ""))
    return words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def _window_words(codes: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Words per text that lie in a three-word window that the text has at least twice."""
    out = np.zeros(len(totals), np.int64)
    base = int(codes.max(initial=0)) + 1
    pair = codes[:-1] * base + codes[1:] if len(codes) > 1 else codes[:0]
    # numbers of pairs are as few as words, so a pair's number and a word fit into 64 bits
    pair = np.unique(pair, return_inverse=True)[1]
    at = 0
    for k, n in enumerate(totals.tolist()):
        if n >= 3:
            key = pair[at : at + n - 2] * base + codes[at + 2 : at + n]
            order = np.argsort(key, kind="stable")
            equal = key[order][1:] == key[order][:-1]
            twice = np.zeros(n - 2, bool)
            twice[order[1:][equal]] = True
            twice[order[:-1][equal]] = True
            covered = np.zeros(n, bool)
            for shift in range(3):
                covered[shift : n - 2 + shift] |= twice
            out[k] = covered.sum()
        at += n
    return out


def viterbi(emission: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Best labels of one sequence. ``emission``: for each line the score of content minus that of boilerplate.

    Only the lead of content over boilerplate is carried; ties go to content.
    """
    (t00, t01), (t10, t11) = transition.tolist()
    lead, back = 0.0, []
    for k, e in enumerate(emission.tolist()):
        if k:
            to0, to1 = lead + t10 >= t00, lead + t11 >= t01
            back.append((to0, to1))
            lead = (lead + t11 if to1 else t01) - (lead + t10 if to0 else t00)
        lead += e
    labels = np.zeros(len(emission), bool)
    label = lead >= 0
    for k in range(len(emission) - 1, -1, -1):
        labels[k] = label
        if k:
            label = back[k - 1][1] if label else back[k - 1][0]
    return labels


def fit(features: np.ndarray, labels: np.ndarray, lengths: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(feature weights, transition) that maximise the penalised likelihood of labelled sequences.

    Weights are of content minus boilerplate; gradients come from forward-backward sums, steps from Adam.
    """
    longest = int(lengths.max())
    begins = np.cumsum(lengths) - lengths
    at = begins[:, None] + np.minimum(np.arange(longest), lengths[:, None] - 1)
    real = np.arange(longest) < lengths[:, None]
    y = labels[at].astype(int)
    weights, transition = np.zeros(N_FEATURES), np.zeros((2, 2))
    moments = [np.zeros(N_FEATURES + 4), np.zeros(N_FEATURES + 4)]
    n = real.sum()
    pairs = real[:, 1:]
    seen = np.array([[((y[:, :-1] == a) & (y[:, 1:] == b) & pairs).sum() for b in (0, 1)] for a in (0, 1)])
    for step in range(1, steps + 1):
        score = np.zeros((len(lengths), longest, 2))
        score[:, :, 1] = weights[features].sum(1)[at] * real
        forward, backward = np.zeros_like(score), np.zeros_like(score)
        forward[:, 0] = score[:, 0]
        for t in range(1, longest):
            move = np.logaddexp(forward[:, t - 1, 0, None] + transition[0], forward[:, t - 1, 1, None] + transition[1])
            forward[:, t] = np.where(real[:, t, None], move + score[:, t], forward[:, t - 1])
        for t in range(longest - 2, -1, -1):
            after = backward[:, t + 1] + score[:, t + 1]
            move = np.logaddexp(after[:, 0, None] + transition[:, 0], after[:, 1, None] + transition[:, 1])
            backward[:, t] = np.where(real[:, t + 1, None], move, backward[:, t + 1])
        norm = np.logaddexp(forward[:, -1, 0], forward[:, -1, 1])
        content = np.exp(forward[:, :, 1] + backward[:, :, 1] - norm[:, None])
        flat = np.zeros(len(labels))
        flat[at[real]] = (y - content)[real]
        gradient = np.bincount(features.ravel(), np.repeat(flat, features.shape[1]), N_FEATURES)
        expected = np.zeros((2, 2))
        for a in (0, 1):
            for b in (0, 1):
                both = forward[:, :-1, a] + transition[a, b] + score[:, 1:, b] + backward[:, 1:, b] - norm[:, None]
                expected[a, b] = np.exp(both[pairs]).sum()
        slope = np.concatenate([gradient / n - 1e-4 * weights, ((seen - expected) / n).ravel() - 1e-4 * transition.ravel()])
        moments[0] = 0.9 * moments[0] + 0.1 * slope
        moments[1] = 0.99 * moments[1] + 0.01 * slope**2
        change = 0.2 * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        weights, transition = weights + change[:N_FEATURES], transition + change[N_FEATURES:].reshape(2, 2)
    return weights, transition


def _slices(batch: pa.RecordBatch, texts: int) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``TOGETHER`` characters in column ``texts``."""
    sizes = np.cumsum(pc.utf8_length(batch.column(texts)).to_numpy(zero_copy_only=False)) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(sizes)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (part for whole in batches for part in _slices(whole, 0)):
        texts, good = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        _, first, features, _ = measure(texts)
        rows = [features[a:b].astype(np.uint8).tobytes() for a, b in zip(first, first[1:], strict=False)]
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), pa.array(good, pa.bool_())], ["lines", "good"])


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> tuple[np.ndarray, np.ndarray] | None:
    """The fitted field, or None without labelled documents of both kinds."""
    known = labels.where("quality IS NOT NULL").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    total = dict(known.groupBy("good").count().collect())
    if len(total) < 2:
        return None
    slots = 1 << 20
    # as many of either kind as the bound allows
    limit = F.when(F.col("good"), min(slots, rows * slots // 2 // total[True])).otherwise(min(slots, rows * slots // 2 // total[False]))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(slots)) < limit)
    short = docs.where(F.length("text") <= chars).join(F.broadcast(chosen), "doc_id").select("text", "good")
    found = short.mapInArrow(_lines, "lines binary, good boolean").orderBy(F.xxhash64("lines"), "good").collect()
    if not found:
        return None
    features, marks, lengths = [], [], []
    again = int(OFFSETS[list(CUTS).index("again")]) + 1
    for row in found:
        part = np.frombuffer(row["lines"], np.uint8).reshape(-1, len(CUTS)).astype(np.int64)
        features.append(part)
        marks.append((part != again).all(1) & row["good"])
        lengths += [min(WINDOW, len(part) - at) for at in range(0, len(part), WINDOW)]
    return fit(np.concatenate(features), np.concatenate(marks), np.array(lengths))


JUDGED = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, content_share double, n_lines long, n_content_lines long"
)


def _judge(model: tuple[np.ndarray, np.ndarray] | None, share: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _slices(whole, 1):
                base, first, features, characters = measure(batch.column(1).to_pylist())
                of = np.zeros(len(features), bool)
                if model is not None:
                    emission = model[0][features].sum(1) + LEAN
                    for a, b in zip(first.tolist(), first[1:].tolist(), strict=False):
                        of[a:b] = viterbi(emission[a:b], model[1])
                else:
                    of[:] = True
                content = np.add.reduceat(characters * of, first[:-1]) / np.maximum(base[:, 1], 1)
                failed = (base[:, 0] < LEAST_WORDS) | (100 * base[:, 4] > 50 * base[:, 0])
                columns = [batch.column(0), *[pa.array(base[:, k]) for k in range(5)], pa.array(failed), pa.array(~failed & (content >= share))]
                columns += [pa.array(content), pa.array(np.diff(first)), pa.array(np.add.reduceat(of.astype(np.int64), first[:-1]))]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in JUDGED.split(", ")])

    return run


def judge(docs: DataFrame, labels: DataFrame, share: float = SHARE) -> DataFrame:
    """Base measures, base verdict, verdict and content share of every document."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_judge(train(docs, labels), share), JUDGED)


def query(spark, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
