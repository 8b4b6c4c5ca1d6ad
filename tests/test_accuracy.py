"""Scores, stemming, id decoding and pairing."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from inferlytics.functions.stem import _pattern, stem_column
from inferlytics.operators import accuracy as acc
from inferlytics.operators import prompts, rouge
from inferlytics.plans.pipelines import accuracy_evaluation


def lcs_table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def test_lcs_against_the_full_table():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(14))]
        t = lcs_table(a, b)
        assert rouge.lcs_length(a, b) == t[-1][-1]
        i, j, path = len(a), len(b), []
        while i and j:
            if a[i - 1] == b[j - 1]:
                path.insert(0, i - 1)
                i, j = i - 1, j - 1
            elif t[i][j - 1] > t[i - 1][j]:
                j -= 1
            else:
                i -= 1
        assert rouge.lcs_positions(a, b) == path


def test_lcs_of_long_texts():
    a = [str(i % 977) for i in range(20_000)]
    assert rouge.lcs_length(a, a[::2]) == 10_000


def test_long_runs_of_y(spark):
    words = ["c" * c + "y" * n + tail for c in (0, 1) for n in range(1, 14) for tail in ("", "b", "a")] + ["a" + "y" * n for n in range(1, 14)]
    words += ["byyyyyaayyyyybyy"]

    def pattern(word):
        out = ""
        for ch in word:
            out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
        return out

    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", _pattern(F.col("w")).alias("p")).collect()
    assert {r["w"]: r["p"] for r in rows} == {w: pattern(w) for w in words}


def test_stemmer(spark):
    # Published sample words of the algorithm and its corrections.
    words = (
        "caresses caress flies fli dies die mules mule denied deni died die agreed agre owned own humbled humbl sized size meeting meet "
        "stating state siezing siez itemization item sensational sensat traditional tradit reference refer colonizer colon plotted plot "
        "relational relat conditional condit rational ration happy happi sky sky skies sky enjoy enjoy news news hopping hop falling fall "
        "hissing hiss failing fail filing file triplicate triplic adjustable adjust replacement replac adoption adopt probate probat "
        "rate rate controll control generalizations gener oscillators oscil dying die innings inning feed feed bled bled sing sing "
        "hopefully hope geology geolog goodness good cats cat ties tie be be the the"
    ).split()
    df = spark.createDataFrame(list(zip(words[::2], words[1::2])), "w string, expected string")
    assert [(r["w"], r["s"]) for r in stem_column(df, "w", "s").collect() if r["s"] != r["expected"]] == []


def score(spark, ref, pred, **options):
    pairs = spark.createDataFrame([(1, ref, pred)], "pair_id int, reference string, prediction string")
    return rouge.f1_scores(pairs, "pair_id", **options).first()


def test_rouge_borders(spark):
    same = score(spark, "The cat sat.\nIt ran.", "The cat sat.\nIt ran.")
    assert [same[f"{n}_f1"] for n in acc.SCORES] == [1.0, 1.0, 1.0, 1.0]
    assert set(score(spark, "a b c", "d e f")[1:]) == {0.0}
    assert set(score(spark, "a b c", "")[1:]) == {0.0}
    assert set(score(spark, None, None)[1:]) == {0.0}
    one = score(spark, "police killed the gunman", "police kill the gunman", stem=False)
    assert (one["rouge1_f1"], one["rouge2_f1"], one["rougeL_f1"]) == (0.75, pytest.approx(1 / 3), 0.75)
    assert score(spark, "police killed the gunman", "police kill the gunman")["rouge1_f1"] == 1.0


def test_summary_form_unions_sentences(spark):
    # Reference sentence w1..w5; candidates hit w1 w2 and w1 w3 w5: the union has four tokens.
    r = score(spark, "w1 w2 w3 w4 w5", "w1 w2 w6 w7 w8\nw1 w3 w8 w9 w5", stem=False)
    assert r["rougeLsum_f1"] == pytest.approx(2 * (4 / 5) * (4 / 10) / (4 / 5 + 4 / 10))


def test_rouge_properties(spark):
    rng = random.Random(2)

    def text():
        return " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 30)))

    rows = [(i, text(), text()) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, a string, b string")
    one = {r["id"]: r for r in rouge.f1_scores(df, "id", "a", "b", stem=False).collect()}
    two = {r["id"]: r for r in rouge.f1_scores(df.repartition(7), "id", "b", "a", stem=False).collect()}
    for i, a, b in rows:
        x, y = a.split(), b.split()
        hits = sum(min(x.count(t), y.count(t)) for t in set(x))
        assert one[i]["rouge1_f1"] == pytest.approx(2 * hits / (len(x) + len(y)))
        assert one[i]["rougeL_f1"] == pytest.approx(2 * lcs_table(x, y)[-1][-1] / (len(x) + len(y)))
        for name in ("rouge1_f1", "rouge2_f1", "rougeL_f1"):
            assert one[i][name] == pytest.approx(two[i][name]) and 0 <= one[i][name] <= 1
        assert one[i]["rougeL_f1"] <= one[i]["rouge1_f1"] + 1e-12


def test_hex_round_trip(spark):
    ids = [1, -2, 70000, 5]
    rows = [(0, struct.pack("<4i", *ids).hex()), (1, "0100000"), (2, ""), (3, "zz000000"), (4, "FFFFFFFF"), (5, None)]
    df = spark.createDataFrame(rows, "id int, data string")
    got = [r["token_ids"] for r in acc.decode_hex_ids(df).orderBy("id").collect()]
    assert got == [ids, None, [], None, [-1], None]
    assert [r["token_ids"] for r in acc.decode_hex_ids(df, vocab_size=70000).orderBy("id").collect()][:1] == [[1, 70000, 5]]
    assert [r["token_ids"] for r in acc.decode_hex_ids(df, vocab_size=69999).orderBy("id").collect()][:1] == [[1, 5]]
    assert sorted(r["id"] for r in acc.malformed_hex(df).collect()) == [1, 3]


def hexed(*ids):
    return struct.pack(f"<{len(ids)}i", *ids).hex()


def test_evaluation(spark):
    log = spark.createDataFrame(
        [("a", 0, hexed(1, 2, 99)), ("b", 0, hexed(1, 3)), ("c", 1, hexed(0, 2)), ("d", 7, hexed(1)), ("e", -1, hexed(1))],
        "log_id string, qsl_idx long, data string",
    )
    refs = spark.createDataFrame([(0, "s", "q", "one two"), (1, None, "q", "two")], "sample_idx long, system_prompt string, input string, reference string")
    vocab = spark.createDataFrame([(0, "<s>", True), (1, "one", False), (2, " two", False), (3, " three", False)], "token_id int, piece string, special boolean")
    details, corpus = accuracy_evaluation(log, refs, vocab, 10)
    rows = {r["log_id"]: r for r in details.collect()}
    assert {k: r["prediction"] for k, r in rows.items()} == {"a": "one two", "b": "one three", "c": "two"}
    assert (rows["a"]["rouge1"], rows["b"]["rouge1"], rows["b"]["rougeL"]) == (100.0, 50.0, 50.0)
    record = corpus.first()
    assert (record["rouge1"], record["gen_num"], record["gen_tok_len"], record["tokens_per_sample"]) == (83.3333, 3, 6, 2.0)
    assert record["gen_len"] == len("one two") + len("one three") + len("two") and record["error"] is None
    once, _ = accuracy_evaluation(log, refs, vocab, 10, dedupe_references=True)
    assert sorted(r["log_id"] for r in once.collect()) == ["a", "c"]
    _, empty = accuracy_evaluation(log.where("qsl_idx > 5"), refs, vocab, 10)
    record = empty.first()
    assert (record["error"], record["gen_num"], record["gen_len"], record["tokens_per_sample"], record["rouge1"]) == ("No valid samples", 0, 0, 0.0, None)


def test_sentence_lines(spark):
    df = spark.createDataFrame([(" One. Two!  Three? four ",)], "t string")
    assert acc.normalize_sentences(df, ["t"]).first()["t"] == "One.\nTwo!\nThree?\nfour"


def double_up(frame):
    assert len(frame) <= 3
    return frame.assign(x=frame["x"] * 2)


def test_map_batches(spark):
    df = spark.range(20).select(F.col("id").alias("x"))
    assert sorted(r[0] for r in prompts.map_batches(df, double_up, "x long", batch=3).collect()) == [2 * i for i in range(20)]
