"""Work of scoring stays with the rows: no gram is shuffled, a reference's texts are not copied per sample."""

import collections
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from inferlytics.operators import accuracy as acc
from inferlytics.operators import rouge
from inferlytics.plans import pipelines


def overlap(a, b, n):
    a, b = ([x for x in t if x != "\n"] for t in (a, b))
    grams = [collections.Counter(tuple(t[i : i + n]) for i in range(len(t) - n + 1)) for t in (a, b)]
    return sum((grams[0] & grams[1]).values())


def test_gram_hits_equal_counting(spark):
    rng = random.Random(5)
    words = ["a", "b", "c", "\n", "dd"]
    pairs = [([rng.choice(words) for _ in range(rng.randint(0, 9))], [rng.choice(words) for _ in range(rng.randint(0, 9))]) for _ in range(300)]
    pairs += [([], []), (["a"], ["a"]), (["a", "b"], ["b"]), (["\n"], ["\n"])]
    sides = [pa.array(s, pa.list_(pa.string())) for s in zip(*pairs)]
    want = np.array([[overlap(a, b, n) for n in (1, 2, 3)] for a, b in pairs])
    assert (rouge.gram_hits(*sides, 3) == want).all()
    parts = [*rouge._parts(*sides, 20)]  # in small parts, each pair once and in order
    assert len(parts) > 20 and (np.concatenate([rouge.gram_hits(a, b, 3) for a, b in parts]) == want).all()
    for part in parts:
        assert sum(len(x.flatten()) for x in part) <= 20
    numbers = spark.createDataFrame([(1, [-1, 7, 8, 7], [7, 8, -1])], "k long, ref_tokens array<bigint>, pred_tokens array<bigint>")
    row = rouge.rouge_n(numbers, "k").first()
    assert (row["rouge1_precision"], row["rouge1_recall"], row["rouge2_precision"], row["rouge2_recall"]) == (1.0, 2 / 3, 1.0, 0.5)


def test_scoring_shuffles_no_grams(spark):
    pairs = spark.createDataFrame([(1, "a b", "b a")], "k long, reference string, prediction string")
    plan = rouge.rouge_n(rouge.tokenize_pairs(pairs, "k"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "Generate" not in plan


def test_many_samples_of_one_reference_carry_no_text(spark):
    log = spark.createDataFrame([(f"l{k}", k % 2, "01000000" if k % 3 else "0200000001000000") for k in range(40)] + [("x", -1, "01000000"), (None, 0, "01000000")], "log_id string, qsl_idx long, data string")
    refs = spark.createDataFrame([(0, "in", "Running one. Two", "s"), (1, "in", None, "s")], "sample_idx long, input string, reference string, system_prompt string")
    vocab = spark.createDataFrame([(1, "run", False), (2, "one", False)], "token_id int, piece string, special boolean")
    details, record = pipelines.accuracy_evaluation(log, refs, vocab, 5, sep=" ")
    rows = {r["log_id"]: r for r in details.collect()}
    assert len(rows) == 40 and rows["l0"]["reference"] == "Running one. Two" and rows["l0"]["prediction"] == "one run"
    assert rows["l0"]["rouge1"] == 80.0 and rows["l0"]["rouge2"] == 0.0 and rows["l2"]["rouge1"] == 50.0 and rows["l1"]["rouge1"] == 0.0
    got = record.first()
    assert (got["gen_num"], got["gen_tok_len"], got["error"]) == (40, 54, None)
    whole = spark.createDataFrame([(r["log_id"], r["reference"], r["prediction"], r["n_tokens"]) for r in rows.values()], "pair_id string, reference string, prediction string, n_tokens long")
    same = acc.corpus_accuracy(acc.normalize_sentences(whole, ["reference", "prediction"])).first()
    assert got == same
