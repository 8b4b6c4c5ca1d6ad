"""A log text is searched once, and the lines give what the pattern's groups give."""

import re

import pytest

from inferlytics.functions import logs

TEXTS = [
    "Mean latency (ns) : \t 5.5e+06\nTokens per second:\t7",
    "a:x\rMean latency (ns): 3\n  tokens per second  :  1.2.3",
    ": 4\nMean latency (ns) :\nMean latency (ns) : . \nMean latency (ns) : 9",
    "Mean latency (ns) : 1 : 2\r\nTokens per second : 8E2",
    "", None,
]


@pytest.mark.parametrize("strict", [False, True])
def test_one_search_gives_the_groups(spark, strict):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, text string")
    out = logs.extract_log_metrics(rows, strict=strict)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1
    line = re.compile(logs.FULL_LINE if strict else logs.PLAIN_LINE)
    for r in out.collect():
        # a carriage return begins a line for Spark's pattern as well
        text = re.sub("\r(?!\n)", "\n", r["text"] or "")
        found = [(m[1].strip(" "), m[2]) for m in line.finditer(text)]
        for name in ("mean_latency_ns", "tokens_per_second"):
            want = next((n for label, n in found if label in logs.LOG_LABELS[name]), None)
            try:
                want = float(want)
            except (TypeError, ValueError):
                want = None
            assert r[name] == want, (r["i"], name)
