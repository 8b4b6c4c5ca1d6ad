"""Catalogue queries against their SQL statements on the smallest scale."""

import pytest

from tests.check_oracle import compare, duck

SF = "/root/testdata/sf0.001"
SAMPLE = [
    "aliases_resolved", "memory_gb", "datetime_iso", "quality_report", "framework_wide", "accuracy_entries", "etl_full", "results_roundtrip",
    "price_join", "price_overrides", "kpis", "performance_view", "top_n_systems", "cost_view", "pair_compare", "cost_sensitivity", "similar_counts",
    "request_metrics", "token_latency", "inter_token", "request_fold", "progress", "slo_report", "rule_resolution", "config_violations",
    "log_metrics", "prompt_render", "prompt_fit", "hex_decode", "decode_tokens", "rouge_n", "corpus_accuracy", "accuracy_evaluation", "run_merge",
    "union_runs", "stream_metrics", "stream_token_sessions",
]


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, con, name):
    from __spark_entry__ import oracle_sql, queries

    assert compare(spark, con, name, queries()[name], oracle_sql()[name], SF) is None


def test_every_statement_has_a_query():
    from __spark_entry__ import oracle_sql, queries

    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.count() > 0 and "result_cost_per_million_tokens" in df.columns
