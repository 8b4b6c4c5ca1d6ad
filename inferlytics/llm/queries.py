"""Registered queries of the package and their SQL."""

from __future__ import annotations

from inferlytics.llm import license_scan, line_crf, mixing, packing, periodic_runs, pii, quality_lm, secret_scan, sharding, simhash, topk, vector_codes, warc

QUERIES = {
    "op1_quality_lm": quality_lm.query,
    "op2_simhash": simhash.query,
    "op3_exact_topk": topk.query,
    "op4_best_fit_packing": packing.query,
    "op5_line_crf": line_crf.query,
    "op6_zip_warc": warc.query,
    "op7_source_mixing": mixing.query,
    "op8_lookup_sharding": sharding.query,
    "op9_pii_weak_labels": pii.query,
    "op10_secret_ownership": secret_scan.query,
    "op11_vector_codes": vector_codes.query,
    "op12_license_scan": license_scan.query,
    "op13_periodic_runs": periodic_runs.query,
}

ORACLE: dict[str, str] = {
    "op3_exact_topk": topk.ORACLE,
    "op6_zip_warc": warc.ORACLE,
    "op7_source_mixing": mixing.ORACLE,
    "op11_vector_codes": vector_codes.ORACLE,
    "op12_license_scan": license_scan.ORACLE,
    "op13_periodic_runs": periodic_runs.ORACLE,
}
