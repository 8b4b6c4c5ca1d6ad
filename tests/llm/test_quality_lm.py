"""The classifier learns from every trusted document, for its counts and for its thresholds."""

import math

import pytest
from pyspark.sql import functions as F

from inferlytics.llm import quality_lm
from tests.llm.test_operators import direct_logp, text_of


def test_counts_and_thresholds_come_from_all_trusted_documents(spark):
    good = [text_of(k, 9) for k in range(30)]
    docs = spark.createDataFrame([(k, t, "en") for k, t in enumerate([*good, "zzz ###", ""])], "doc_id long, text string, lang string").repartition(3)
    labels = spark.createDataFrame([(k, 1, 0) for k in range(len(good))], "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality_lm.classify(docs, labels).collect()}
    whole = direct_logp(good, quality_lm.ORDER)
    for k, t in enumerate([*good, "zzz ###", ""]):
        assert rows[k]["perplexity"] == pytest.approx(math.exp(-whole(t) / (len(t) + 1)), rel=1e-9)

    fold = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    nll = {}
    for f in (0, 1):  # counts and scores are held against direct computation in test_operators
        counts = quality_lm.training_counts(docs, labels.where(fold != f).select("doc_id"))
        scored = quality_lm.score(docs.where((fold == f) & (F.col("doc_id") < len(good))), counts)
        nll |= {r["doc_id"]: r["nll"] for r in scored.collect()}
    middle = sum(nll.values()) / sum(len(t) + 1 for t in good)
    bar = max((nll[k] + quality_lm.PRIOR * middle) / (len(t) + 1 + quality_lm.PRIOR) for k, t in enumerate(good))
    assert rows[0]["threshold"] == pytest.approx(math.exp(bar), rel=2 * quality_lm.STEP)


def test_one_trusted_document_rejects_nothing(spark):
    docs = spark.createDataFrame([(1, text_of(1, 9), "en"), (2, "zzz ###", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_lm.classify(docs, labels).collect()
    assert [r["kept"] for r in rows] == [True, True] and all(r["threshold"] is None for r in rows)
