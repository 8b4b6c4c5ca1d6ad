"""Texts meet small tables of keys where they are, whatever Spark's own size threshold says."""

import re

import pytest

from inferlytics.llm import quality_lm, simhash
from inferlytics.llm.common import beside_texts, keep_rows, text_key
from tests.llm.test_operators import text_of

ROWS = [(1, "a b", "en"), (1, "c d", "en"), (None, "a b", "en"), (None, "e", "de"), (2, "a b", None), (2, "a b", "en"), (3, None, "en")]


@pytest.fixture
def small_threshold(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def documents(spark):
    return spark.createDataFrame([(*r, "s", 0) for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_keys_go_to_the_texts(spark, small_threshold, how):
    docs = documents(spark)
    named = [(None, "a b"), (2, "a b"), (3, None), (9, "c d")]
    keys = spark.createDataFrame(named, "doc_id long, text string").select("doc_id", text_key("text").alias("text_key"))
    kept = keep_rows(docs, keys, how)
    assert "Exchange hashpartitioning" not in plan_of(kept)
    want = sorted(r for r in map(repr, ROWS) if (eval(r)[:2] in named) == (how == "left_semi"))
    assert sorted(repr((r["doc_id"], r["text"], r["lang"])) for r in kept.collect()) == want


def test_more_keys_are_left_to_spark(spark, small_threshold):
    ids = spark.range(3).toDF("doc_id")
    for most, broadcast in ((3, True), (2, False)):
        joined = documents(spark).join(beside_texts(ids, "ids", most), "doc_id", "left_semi")
        assert ("BroadcastHashJoin" in plan_of(joined)) == broadcast
        assert joined.count() == 4


def test_trusted_texts_are_not_shuffled(spark, small_threshold, monkeypatch):
    plans = []
    monkeypatch.setattr(quality_lm, "settle", lambda df, name: plans.append(plan_of(df)) or df)
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, None), (3, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    good = quality_lm.trusted_rows(documents(spark), labels)
    assert "BroadcastHashJoin" in plans[-1] and "Exchange hashpartitioning" not in plans[-1]
    assert sorted((r["doc_id"], r["text"]) for r in good.collect()) == [(1, "a b"), (1, "c d"), (2, "a b"), (2, "a b")]


def test_repeats_are_dropped_where_the_join_left_them(spark, small_threshold):
    rows = [(*r, "s", 0) for r in [*ROWS, (0, text_of(1, 40), "en"), (5, text_of(1, 40), "en")]]
    docs = spark.createDataFrame(rows, documents(spark).schema)
    kept = simhash.stage(spark, docs, "")
    moves = {m for m in re.findall(r"Exchange hashpartitioning\((.*?), ENSURE", plan_of(kept)) if "_key#" in m}
    assert len(moves) == 2  # texts and keys, once each
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr)
    assert got == sorted([(0, text_of(1, 40)), (1, "a b"), (1, "c d"), (3, None), (None, "e")], key=repr)
