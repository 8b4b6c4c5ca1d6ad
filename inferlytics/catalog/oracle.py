"""The queries of the catalogue stated again in SQL, for a second engine (DuckDB).

Each statement is built from the base tables alone: the views below are common table
expressions, put in front of a statement when it (or a view it uses) names them.
"""

from __future__ import annotations

import re

from ..functions import hardware as hw
from ..functions import stem as st
from . import bridge


def _case(index: str, values: list[str]) -> str:
    return "CASE " + index + " " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _clean(c: str) -> str:
    return f"CASE WHEN upper({c}) IN ('', 'N/A', 'DUMMY') THEN NULL ELSE {c} END"


def _part_gb(p: str) -> str:
    u = f"upper(replace({p}, ' ', ''))"
    n = f"try_cast(regexp_extract({u}, '^([0-9.]*)', 1) AS DOUBLE)"
    return (
        f"CASE WHEN contains({u}, 'TB') OR contains({u}, 'TIB') THEN {n} * 1024 "
        f"WHEN contains({u}, 'GB') OR contains({u}, 'GIB') THEN {n} END"
    )


def _memory(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, '+') THEN nullif(list_sum(list_transform(string_split({c}, '+'), "
        f"lambda p: coalesce({_part_gb('p')}, 0::DOUBLE))), 0) ELSE {_part_gb(c)} END"
    )


def _frequency(c: str) -> str:
    top = f"list_max(list_transform(regexp_extract_all(upper({c}), '([0-9.]+)', 1), lambda x: try_cast(x AS DOUBLE)))"
    return (
        f"CASE WHEN {c} IS NULL OR {c} IN ('', 'undefined') THEN NULL "
        f"WHEN regexp_full_match({c}, '\\s*\\d+\\s*') THEN try_cast(trim({c}) AS DOUBLE) / 1000 "
        f"WHEN contains(upper({c}), 'MHZ') THEN {top} / 1000 ELSE {top} END"
    )


def _iso(c: str) -> str:
    return (
        f"CASE WHEN contains({c}, '/') AND contains({c}, '_') THEN CASE WHEN try_cast(translate({c}, '/_', '-T') AS TIMESTAMP) "
        f"IS NOT NULL THEN translate({c}, '/_', '-T') END ELSE strftime(try_strptime({c}, ['%Y-%m-%d %H:%M:%S', "
        f"'%Y/%m/%d %H:%M:%S', '%Y-%m-%dT%H:%M:%S']), '%Y-%m-%dT%H:%M:%S') END"
    )


def _interconnect(c: str) -> str:
    u = f"upper({c})"
    return (
        f"CASE WHEN {u} IN ('TBD', 'TODO', 'TODD') THEN NULL WHEN contains({u}, 'NVLINK') THEN CASE WHEN contains({u}, '5TH') "
        f"THEN 'NVLink-5' WHEN contains({u}, '4TH') THEN 'NVLink-4' ELSE 'NVLink' END WHEN contains({u}, 'PCIE') THEN CASE WHEN "
        f"contains(replace({u}, ' ', ''), 'GEN5') THEN 'PCIe-5' ELSE 'PCIe' END WHEN contains({u}, 'INFINIBAND') THEN 'InfiniBand' "
        f"WHEN contains({u}, 'XGMI') THEN 'XGMI' ELSE {c} END"
    )


def _keyword(c: str, rules) -> str:
    whens = [
        "WHEN " + " OR ".join(f"contains(upper({c}), '{w}')" for w in words) + f" THEN '{name}'" for name, words in rules
    ]
    return "CASE " + " ".join(whens) + " END"


def _params(c: str) -> str:
    return "CASE " + " ".join(f"WHEN starts_with(lower({c}), '{p.lower()}') THEN {n}::DOUBLE" for p, n in hw.MODEL_PARAMETERS) + " END"


def _arch(c: str) -> str:
    known = " OR ".join(f"contains(lower({c}), '{p}')" for p in hw.LLM_PATTERNS)
    return f"CASE WHEN {c} IS NULL OR {c} = '' THEN NULL WHEN {known} THEN 'LLM' ELSE 'Other' END"


def _framework(c: str, name: str) -> str:
    item = f"list_filter(string_split({c}, ','), lambda i: lower(regexp_extract(trim(i), '(\\w+)\\s+', 1)) = '{name}' AND regexp_extract(trim(i), '\\s+([0-9.]+)', 1) <> '')[1]"
    return f"trim(regexp_extract(trim({item}), '\\s+([0-9.]+)', 1), '.')"


def _frameworks(c: str) -> str:
    """``name=version`` of all frameworks, by name."""
    return (
        f"array_to_string(list_sort(list_transform(list_filter(string_split({c}, ','), lambda i: regexp_matches(trim(i), '^\\w+ [0-9.]+$')), "
        f"lambda i: lower(string_split(trim(i), ' ')[1]) || '=' || string_split(trim(i), ' ')[2])), ';')"
    )


_ENGINE = (
    "CASE WHEN l_suppkey % 3 = 0 THEN 'TensorRT' "
    "ELSE 'TensorRT 10.' || l_linenumber || ', Engine' || l_suppkey || ' 1.' || (l_partkey % 9) END"
)

_STAMP = (
    "make_timestamp(2000 + s_suppkey // 29030400, 1 + (s_suppkey // 2419200) % 12, 1 + (s_suppkey // 86400) % 28, "
    "(s_suppkey // 3600) % 24, (s_suppkey // 60) % 60, (s_suppkey % 60)::DOUBLE)"
)

_TEXTS = [
    "organization", "division", "availability", "scenario", "system", "units", "accuracy", "model", "accelerator",
    "nodes", "per_node", "accelerator_memory", "host_memory", "cpu", "frequency", "interconnect", "framework", "stamp",
]

_TRIM = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
_TOKENS = "regexp_extract_all(lower({}), '[a-z0-9]+')"

VIEWS = {
    "v_raw": f"""
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::INT) AS uid,
  n_name AS organization,
  CASE l_returnflag WHEN 'A' THEN 'closed' WHEN 'N' THEN 'open' WHEN 'R' THEN 'N/A' END AS division,
  o_orderstatus AS availability,
  CASE l_linestatus WHEN 'F' THEN 'Offline' WHEN 'O' THEN 'Server' END AS scenario,
  s_name AS system,
  CASE WHEN l_linenumber = 7 THEN 'Samples/s' ELSE 'Tokens/s' END AS units,
  CASE WHEN l_quantity = 50 THEN NULL WHEN l_quantity = 49 THEN 0 ELSE l_extendedprice END AS result,
  CASE WHEN l_linenumber <> 6 THEN 'ROUGE1: ' || l_quantity::INT || '  ROUGE2: ' || l_linenumber END AS accuracy,
  {_case('l_partkey % 7', ["'llama2-70b-99'", "'gptj-99'", "'mixtral-8x7b'", "'DeepSeek-R1-Distill-Llama-8B'", "'resnet50'", "''", "'Llama3_1-405B'"])} AS model,
  {_case('p_size % 8', ["'NVIDIA H100 '", "'AMD Instinct '", "'Intel Gaudi2 '", "'TPU-v5e '", "'Qualcomm Cloud AI 100 '", "'speedAI '", "'Custom '"])} || p_brand AS accelerator,
  CASE WHEN p_size % 10 <> 0 THEN (1 + l_linenumber % 4)::VARCHAR END AS nodes,
  CASE WHEN p_size % 13 = 0 THEN '0' WHEN p_size % 17 = 0 THEN '2x' ELSE (1 + p_size % 8)::VARCHAR END AS per_node,
  {_case('l_linenumber % 6', ["'80 GB'", "'1.5 TB'", "p_size || ' GiB + 64GB'", "'N/A'", "'512MB'", "'0GB + 0GB'"])} AS accelerator_memory,
  {_case('l_partkey % 4', ["'2 TiB'", "p_size || ' GB'", "NULL", "'HBM 80GB'"])} AS host_memory,
  {_case('l_suppkey % 6', ["'AMD EPYC 9654'", "'Intel Xeon 8480'", "'NVIDIA Grace'", "'Neoverse-V2'", "'Apple M2'", "'Unknown'"])} AS cpu,
  {_case('l_suppkey % 5', ["'2.0 GHz (3.5GHz turbo)'", "'2400'", "'3800 MHz'", "'undefined'", "''"])} AS frequency,
  {_case('l_linenumber % 7', ["'NVLink 5th-gen'", "'nvlink 4th'", "'NVLink'", "'PCIe Gen5 x16'", "'PCIe'", "'TBD'", "'Infinity Fabric'"])} AS interconnect,
  {_case('l_linenumber % 4', ["'PyTorch 2.5.1, CUDA 12.4'", "'vLLM 0.7.3'", _ENGINE, "NULL"])} AS framework,
  {_case('l_linenumber % 3', ["'2025/04/03_22:56:53'", "'2025-04-03 22:56:53'", "'N/A'"])} AS stamp
FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey
LEFT JOIN nation ON s_nationkey = n_nationkey LEFT JOIN orders ON l_orderkey = o_orderkey""",
    "v_clean": "SELECT uid, result, " + ", ".join(f"{_clean(c)} AS {c}" for c in _TEXTS) + " FROM v_raw",
    "v_counts": """
SELECT *, try_cast(nodes AS BIGINT) AS n, try_cast(per_node AS BIGINT) AS p,
  try_cast(nodes AS BIGINT) * try_cast(per_node AS BIGINT) AS total,
  coalesce(try_cast(nodes AS BIGINT), 1) * coalesce(try_cast(per_node AS BIGINT), 1) AS total_one FROM v_raw""",
    "v_prices": """
SELECT DISTINCT accelerator AS name, round(length(accelerator) * 0.1::DOUBLE, 2) AS price_per_hour
FROM v_raw WHERE accelerator IS NOT NULL AND NOT ends_with(accelerator, '5')""",
    "v_overrides": """
SELECT name, 9.99::DOUBLE AS price_per_hour FROM v_prices WHERE ends_with(name, '1')
UNION ALL SELECT 'Override Only', 9.99::DOUBLE""",
    "v_priced": """
SELECT c.*, price_per_hour AS unit_price, total_one * price_per_hour AS system_price
FROM v_counts c LEFT JOIN v_prices ON accelerator = name""",
    "v_board": """
SELECT *, result AS tokens_per_second,
  system_price / nullif(result, 0) * 1000000 AS cost_per_million,
  system_price / nullif(result, 0) * 1000000 / 3600 AS usd_per_million FROM v_priced WHERE units = 'Tokens/s'""",
    "v_best": """
SELECT * FROM v_board WHERE accelerator IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY model, accelerator, total_one ORDER BY tokens_per_second DESC NULLS LAST, uid DESC) = 1""",
    "v_pairs": """
SELECT b.*, a.accelerator AS accelerator_a, a.total_one AS count_a, a.system AS system_a, a.tokens_per_second AS perf_a,
  a.system_price AS price_a, a.uid AS uid_a
FROM v_best b JOIN (SELECT * FROM v_best WHERE system_price IS NOT NULL QUALIFY row_number() OVER (
  PARTITION BY model ORDER BY tokens_per_second DESC NULLS LAST, uid DESC) = 1) a
ON a.model = b.model AND a.uid <> b.uid""",
    "v_events": "SELECT *, regexp_extract(props, '\"k\": (\\d+)', 1)::INT AS k FROM events",
    "v_requests": """
SELECT event_id, 'run' || user_id % 5 AS run_id, ts, value AS latency_s,
  CASE WHEN event_type = 'error' THEN 0 ELSE k END AS output_tokens, length(props) AS prompt_len FROM v_events""",
    "v_chunks": """
SELECT user_id, epoch_us(ts) // 86400000000 AS day, 'run' || user_id % 5 AS run_id, epoch_us(ts) AS us, event_id AS seq,
  (epoch_us(ts) // 86400000000) * 86400000000 AS start_us, event_type AS text FROM events WHERE event_type <> 'error'""",
    "v_request_tokens": """
SELECT user_id, day, run_id, (min(us) - min(start_us)) / 1e6 AS ttft_s, (max(us) - min(start_us)) / 1e6 AS latency_s,
  count(*) AS output_tokens,
  CASE WHEN count(*) > 1 THEN (max(us) - min(us)) / 1e6 / (count(*) - 1) END AS tpot_s FROM v_chunks GROUP BY ALL""",
    "v_run_metrics": """
SELECT run_id, count(*) FILTER (output_tokens > 0) > 0 AS valid, count(*) FILTER (output_tokens > 0) AS completed,
  count(*) AS total_samples,
  coalesce(count(*) FILTER (output_tokens > 0) / (max(epoch_us(ts) / 1e6 + latency_s) - min(epoch_us(ts) / 1e6)), 0) AS samples_per_second,
  coalesce(sum(prompt_len + output_tokens) FILTER (output_tokens > 0) / (max(epoch_us(ts) / 1e6 + latency_s) - min(epoch_us(ts) / 1e6)), 0) AS tokens_per_second,
  coalesce(avg(latency_s * 1e9) FILTER (output_tokens > 0), 0) AS mean_latency_ns,
  coalesce(quantile_cont(latency_s * 1e9, 0.5) FILTER (output_tokens > 0), 0) AS p50_latency_ns,
  coalesce(quantile_cont(latency_s * 1e9, 0.9) FILTER (output_tokens > 0), 0) AS p90_latency_ns,
  coalesce(quantile_cont(latency_s * 1e9, 0.99) FILTER (output_tokens > 0), 0) AS p99_latency_ns
FROM v_requests GROUP BY run_id""",
    "v_token_metrics": "SELECT run_id, count(*) AS requests, "
    + ", ".join(
        f"{expr} AS {stat}_{name}"
        for name, c in (("first_token_latency_ns", "ttft_s * 1e9"), ("tpot_ns", "tpot_s * 1e9"))
        for stat, expr in [
            ("min", f"min({c})"), ("max", f"max({c})"), ("mean", f"avg({c})"),
            *[(s, f"quantile_cont({c}, {p})") for s, p in (("p50", 0.5), ("p90", 0.9), ("p95", 0.95), ("p97", 0.97), ("p99", 0.99), ("p99_9", 0.999))],
        ]
    )
    + " FROM v_request_tokens GROUP BY run_id",
    "v_slo_model": """
SELECT *, 'Server' AS scenario, CASE run_id WHEN 'run0' THEN 'llama2-70b' WHEN 'run1' THEN 'llama2-70b-interactive'
  WHEN 'run2' THEN 'mixtral-8x7b' WHEN 'run3' THEN 'llama3_1-405b' ELSE 'gptj' END AS model FROM v_run_metrics""",
    "v_rules": "SELECT * FROM (VALUES "
    + ", ".join(
        "({}, '{}', '{}', '{}', {}::DOUBLE)".format(layer, *line.split(" = ")[0].split("."), line.split(" = ")[1])
        for layer, text in ((0, bridge.SERVER_RULES), (1, bridge.USER_RULES))
        for line in text.strip().split("\n")
    )
    + ") t(layer, r_model, r_scenario, key, value)",
    "v_resolved": """
SELECT m.model, m.scenario, key, value FROM (SELECT DISTINCT model, scenario FROM v_slo_model) m JOIN v_rules
  ON r_model IN (m.model, '*') AND r_scenario IN (m.scenario, '*')
QUALIFY row_number() OVER (PARTITION BY m.model, m.scenario, key ORDER BY layer DESC, r_model = '*', r_scenario = '*') = 1""",
    "v_prompts": f"""
SELECT row_number() OVER (ORDER BY u.conv_id, u.turn) - 1 AS sample_idx, u.conv_id, u.turn, u.text AS input, a.text AS reference,
  s.text AS system_prompt, u.text AS prediction,
  {_case('u.conv_id % 5', ["'meta-llama/llama2-7b'", "'meta/llama3-8b'", "'meta-llama/Llama-3.2-1B'", "'DeepSeek-R1'", "'other'"])} AS model_path
FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn AND u.role = 'user' AND a.role = 'assistant'
LEFT JOIN (SELECT conv_id, min_by(text, turn) AS text FROM conversations WHERE role = 'system' GROUP BY conv_id) s ON u.conv_id = s.conv_id""",
    "v_log": """
SELECT user_id || '-' || day AS log_id, (row_number() OVER (ORDER BY user_id, day) - 1) % 300 AS qsl_idx, data FROM (
  SELECT user_id, epoch_us(ts) // 86400000000 AS day,
    string_agg(lpad(lower(to_hex(k)), 2, '0') || '000000', '' ORDER BY ts, event_id) AS data FROM v_events GROUP BY ALL)
UNION ALL SELECT 'outside', -1, '01000000'""",
    "v_ids": """
SELECT log_id, qsl_idx, list_filter(list_transform(range(0, length(data) // 8), lambda i:
  ('0x' || substr(data, i * 8 + 7, 2) || substr(data, i * 8 + 5, 2) || substr(data, i * 8 + 3, 2) || substr(data, i * 8 + 1, 2))::BIGINT),
  lambda t: t >= 0 AND t <= 90) AS ids FROM v_log""",
    "v_decoded": """
SELECT log_id, coalesce(list_aggregate(list_transform(list_filter(ids, lambda t: t % 25 <> 0), lambda t: 't' || t), 'string_agg', ' '), '') AS text,
  len(ids) AS n_tokens FROM v_ids""",
    "v_samples": """
SELECT l.log_id AS id, p.reference, d.text AS prediction, d.n_tokens FROM v_log l JOIN v_prompts p ON l.qsl_idx = p.sample_idx
JOIN v_decoded d ON d.log_id = l.log_id""",
    "v_perf": """
SELECT o_orderkey::VARCHAR AS run_id, CASE WHEN o_orderkey % 10 <> 1 THEN o_totalprice END AS samples_per_second,
  CASE WHEN o_orderkey % 4 = 0 THEN 'PerformanceOnly' END AS mode, o_orderstatus AS scenario FROM orders WHERE o_orderkey % 3 <> 0""",
    "v_acc": """
SELECT o_orderkey::VARCHAR AS run_id, o_totalprice / 2 AS samples_per_second, (o_orderkey % 100)::DOUBLE AS rouge1
FROM orders WHERE o_orderkey % 2 = 0""",
    "v_acc_results": "SELECT o_orderkey::VARCHAR AS run_id, o_orderkey % 7 AS gen_num FROM orders WHERE o_orderkey % 4 = 0",
    "v_merged": """
SELECT run_id, coalesce(p.samples_per_second, a.samples_per_second) AS samples_per_second,
  coalesce(p.scenario, CASE WHEN a.run_id IS NOT NULL THEN 'Offline' END) AS scenario, a.rouge1,
  CASE WHEN p.run_id IS NOT NULL AND (a.run_id IS NOT NULL OR r.run_id IS NOT NULL) THEN 'PerformanceAndAccuracy'
    WHEN p.run_id IS NOT NULL THEN coalesce(p.mode, 'PerformanceOnly') ELSE 'AccuracyOnly' END AS mode,
  gen_num, r.run_id IS NOT NULL AS has_results
FROM v_perf p FULL JOIN v_acc a USING (run_id) FULL JOIN v_acc_results r USING (run_id)""",
}


def _rouge(source: str, key: str, stem: bool = False) -> str:
    """ROUGE-1 and ROUGE-2 of (key, reference, prediction) rows, unrounded, as CTEs."""
    parts = [
        f"tok AS (SELECT {key} AS id, {_TOKENS.format('reference')} AS r, {_TOKENS.format('prediction')} AS p FROM {source})"
    ]
    if stem:
        parts.append(_stems())
    for side in "rp":
        if stem:
            parts.append(
                f"w_{side} AS (SELECT id, pos, stem FROM (SELECT id, unnest({side}) AS word, unnest(range(1, len({side}) + 1)) AS pos FROM tok) JOIN stems USING (word)), "
                f"g_{side} AS (SELECT id, 1 AS n, stem AS gram FROM w_{side} UNION ALL SELECT id, 2, gram FROM "
                f"(SELECT id, stem || ' ' || lead(stem) OVER (PARTITION BY id ORDER BY pos) AS gram FROM w_{side}) WHERE gram IS NOT NULL)"
            )
        else:
            parts.append(
                f"g_{side} AS (SELECT id, 1 AS n, unnest({side}) AS gram FROM tok UNION ALL SELECT id, 2, "
                f"unnest(list_transform(range(1, len({side})), lambda i: {side}[i] || ' ' || {side}[i + 1])) FROM tok)"
            )
        parts.append(f"c_{side} AS (SELECT id, n, gram, count(*) AS c FROM g_{side} GROUP BY ALL)")
    parts.append("hit AS (SELECT id, n, sum(least(c_r.c, c_p.c)) AS h FROM c_r JOIN c_p USING (id, n, gram) GROUP BY ALL)")
    parts.append(
        "pr AS (SELECT tok.id, o.n, coalesce(h / nullif(len(p) - o.n + 1, 0), 0) AS prec, "
        "coalesce(h / nullif(len(r) - o.n + 1, 0), 0) AS rec FROM tok CROSS JOIN (VALUES (1), (2)) o(n) LEFT JOIN hit ON hit.id = tok.id AND hit.n = o.n)"
    )
    parts.append("sc AS (SELECT id, n, prec, rec, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 FROM pr)")
    return ", ".join(parts)


def _stems() -> str:
    """Stems of the distinct words of tok(id, r, p), as CTEs ending in stems(word, stem)."""
    letters = "abcdefghijklmnopqrstuvwxyz0123456789"
    classes = "".join("y" if ch == "y" else "v" if ch in "aeiou" else "c" for ch in letters)

    def pattern(w: str) -> str:
        out = f"regexp_replace(translate({w}, '{letters}', '{classes}'), '^y', 'c')"
        kind = "CASE WHEN x <> 'y' THEN x WHEN right(a, 1) = 'c' THEN 'v' ELSE 'c' END"
        return f"CASE WHEN contains({w}, 'y') THEN list_reduce(string_split({out}, ''), lambda a, x: a || {kind}) ELSE {out} END"

    def stem(cut: int) -> str:
        return f"left(w, length(w) - {cut})"

    def cv(cut: int) -> str:
        return f"left(cv, length(cv) - {cut})"

    def m(cut: int) -> str:
        return f"len(regexp_extract_all({cv(cut)}, 'vc'))"

    def short(cut: int) -> str:
        return f"((ends_with({cv(cut)}, 'cvc') AND right({stem(cut)}, 1) NOT IN ('w', 'x', 'y')) OR {cv(cut)} = 'vc')"

    def rules(items) -> str:
        """(suffix, replacement, condition) list as one CASE."""
        whens = [
            f"WHEN ends_with(w, '{x}') THEN CASE WHEN {cond(len(x))} THEN {stem(len(x))} || '{put}' ELSE w END" for x, put, cond in items
        ]
        return "CASE " + " ".join(whens) + " ELSE w END"

    def always(_: int) -> str:
        return "true"

    def some(cut: int) -> str:
        return f"{m(cut)} > 0"

    def mended(cut: int) -> str:
        b, c = stem(cut), cv(cut)
        double = f"length({b}) >= 2 AND right({b}, 1) = left(right({b}, 2), 1) AND ends_with({c}, 'c')"
        return (
            f"CASE WHEN ends_with({b}, 'at') OR ends_with({b}, 'bl') OR ends_with({b}, 'iz') THEN {b} || 'e' "
            f"WHEN {double} THEN CASE WHEN right({b}, 1) IN ('l', 's', 'z') THEN {b} ELSE left({b}, length({b}) - 1) END "
            f"WHEN {m(cut)} = 1 AND {short(cut)} THEN {b} || 'e' ELSE {b} END"
        )

    def long_stem(x: str):
        return lambda cut: f"{m(cut)} > 1" + (f" AND right({stem(cut)}, 1) IN ('s', 't')" if x == "ion" else "")

    steps = [
        f"CASE WHEN ends_with(w, 'ies') AND length(w) = 4 THEN {stem(1)} ELSE "
        + rules([("sses", "ss", always), ("ies", "i", always), ("ss", "ss", always), ("s", "", always)]) + " END",
        f"CASE WHEN ends_with(w, 'ied') THEN CASE WHEN length(w) = 4 THEN {stem(1)} ELSE {stem(2)} END "
        f"WHEN ends_with(w, 'eed') THEN CASE WHEN {m(3)} > 0 THEN {stem(1)} ELSE w END "
        f"WHEN ends_with(w, 'ed') AND contains({cv(2)}, 'v') THEN {mended(2)} "
        f"WHEN ends_with(w, 'ing') AND contains({cv(3)}, 'v') THEN {mended(3)} ELSE w END",
        f"CASE WHEN ends_with(w, 'y') AND length(w) > 2 AND ends_with({cv(1)}, 'c') THEN {stem(1)} || 'i' ELSE w END",
        f"CASE WHEN ends_with(w, 'alli') AND {m(4)} > 0 THEN {stem(2)} ELSE w END",
        rules([(a, b, some) for a, b in st.STEP_2] + [("logi", "log", lambda cut: f"{m(cut - 1)} > 0")]),
        rules([(a, b, some) for a, b in st.STEP_3]),
        rules([(x, "", long_stem(x)) for x in st.STEP_4]),
        f"CASE WHEN ends_with(w, 'e') AND ({m(1)} > 1 OR ({m(1)} = 1 AND NOT {short(1)})) THEN {stem(1)} ELSE w END",
        f"CASE WHEN ends_with(w, 'll') AND {m(1)} > 1 THEN {stem(1)} ELSE w END",
    ]
    parts = ["st0 AS (SELECT DISTINCT word, word AS w FROM (SELECT unnest(r) AS word FROM tok UNION SELECT unnest(p) FROM tok))"]
    for i, step in enumerate(steps):
        parts.append(f"st{i + 1} AS (SELECT word, {step} AS w FROM (SELECT *, {pattern('w')} AS cv FROM st{i}))")
    fixed = " ".join(f"WHEN '{form}' THEN '{root}'" for root, forms in st.IRREGULAR.items() for form in forms)
    parts.append(f"stems AS (SELECT word, CASE WHEN length(word) < 4 THEN word ELSE CASE word {fixed} ELSE w END END AS stem FROM st{len(steps)})")
    return ", ".join(parts)


def _lines(c: str) -> str:
    return f"regexp_replace(trim({c}, {_TRIM}), '([.!?])\\s+', '\\1' || chr(10), 'g')"


#: Row after row of the table of common lengths of lists a and b; the first row is all zero.
_COMMON = """list_reduce(list_transform(a, lambda x: [list_transform(b, lambda y: (x = y)::BIGINT)]),
    lambda acc, hit: list_append(acc, list_transform([list_transform(range(1, len(b) + 1), lambda j:
      CASE WHEN hit[1][j] = 1 THEN coalesce(acc[-1][j - 1], 0) + 1 ELSE acc[-1][j] END)],
      lambda c: list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])))[1]),
    [list_transform(b, lambda y: 0::BIGINT)])"""
#: One longest common subsequence as places in a, found from the end of the table t.
_PATH = """list_reduce(list_transform(range(len(a) + len(b) + 1), lambda k: {'i': len(a)::BIGINT, 'j': len(b)::BIGINT, 'f': []::BIGINT[]}),
    lambda s, x: CASE WHEN s.i = 0 OR s.j = 0 THEN s WHEN a[s.i] = b[s.j] THEN {'i': s.i - 1, 'j': s.j - 1, 'f': list_append(s.f, s.i)}
      WHEN coalesce(t[s.i + 1][s.j - 1], 0) > t[s.i][s.j] THEN {'i': s.i, 'j': s.j - 1, 'f': s.f} ELSE {'i': s.i - 1, 'j': s.j, 'f': s.f} END).f"""


def _subsequences(source: str, key: str, lines: bool = True, stem: bool = False) -> str:
    """Subsequence scores of (key, reference, prediction) rows as CTEs after those of ``_rouge``, ending in lsc(id, name, prec, rec, f1)."""
    parts = []
    for side, col in (("r", "reference"), ("p", "prediction")):
        text = f"string_split({_lines(col) if lines else col}, chr(10))"
        parts.append(
            f"n_{side} AS (SELECT id, sno, {_TOKENS.format('x')} AS t FROM (SELECT {key} AS id, unnest({text}) AS x, unnest(range(len({text}))) AS sno FROM {source}))"
        )
        if stem:
            parts.append(
                f"s_{side} AS (SELECT id, sno, list(stem ORDER BY pos) AS t FROM (SELECT id, sno, unnest(t) AS word, unnest(range(len(t))) AS pos FROM n_{side}) "
                "JOIN stems USING (word) GROUP BY id, sno)"
            )
        else:
            parts.append(f"s_{side} AS (SELECT * FROM n_{side} WHERE len(t) > 0)")
        parts.append(f"a_{side} AS (SELECT id, flatten(list(t ORDER BY sno)) AS t FROM s_{side} GROUP BY id)")
    parts += [
        f"whole AS (SELECT id, {_COMMON}[-1][-1] AS h FROM (SELECT id, a_r.t AS a, a_p.t AS b FROM a_r JOIN a_p USING (id)))",
        f"tabled AS (SELECT *, {_COMMON} AS t FROM (SELECT id, s_r.sno, s_r.t AS a, s_p.t AS b FROM s_r JOIN s_p USING (id)))",
        f"taken AS (SELECT DISTINCT id, sno, a[place] AS word, place FROM (SELECT id, sno, a, unnest({_PATH}) AS place FROM tabled))",
        "given AS (SELECT id, word, count(*) AS n FROM (SELECT id, unnest(t) AS word FROM s_p) GROUP BY ALL)",
        "summed AS (SELECT id, sum(least(k, n)) AS h FROM (SELECT id, word, count(*) AS k FROM taken GROUP BY ALL) JOIN given USING (id, word) GROUP BY id)",
        "lpr AS (SELECT tok.id, name, coalesce(CASE name WHEN 'L' THEN whole.h ELSE summed.h END, 0) AS h, len(a_r.t) AS nr, len(a_p.t) AS np "
        "FROM tok CROSS JOIN (VALUES ('L'), ('Lsum')) o(name) LEFT JOIN whole USING (id) LEFT JOIN summed USING (id) LEFT JOIN a_r USING (id) LEFT JOIN a_p USING (id))",
        "lsc AS (SELECT *, coalesce(2 * prec * rec / nullif(prec + rec, 0), 0) AS f1 "
        "FROM (SELECT id, name, coalesce(h / nullif(np, 0), 0) AS prec, coalesce(h / nullif(nr, 0), 0) AS rec FROM lpr))",
    ]
    return ", " + ", ".join(parts)


_FOUR = (
    ", f1s AS (SELECT id, round_even(max(f1) FILTER (n = 1) * 100, 4) AS rouge1, round_even(max(f1) FILTER (n = 2) * 100, 4) AS rouge2 FROM sc GROUP BY id), "
    "fls AS (SELECT id, round_even(max(f1) FILTER (name = 'L') * 100, 4) AS \"rougeL\", round_even(max(f1) FILTER (name = 'Lsum') * 100, 4) AS \"rougeLsum\" FROM lsc GROUP BY id)"
)


def _record(source: str, tokens: str) -> str:
    return f"""
SELECT (SELECT round_even(avg(f1) FILTER (n = 1) * 100, 4) FROM sc) AS rouge1, (SELECT round_even(avg(f1) FILTER (n = 2) * 100, 4) FROM sc) AS rouge2,
  (SELECT round_even(avg(f1) FILTER (name = 'L') * 100, 4) FROM lsc) AS "rougeL", (SELECT round_even(avg(f1) FILTER (name = 'Lsum') * 100, 4) FROM lsc) AS "rougeLsum",
  (SELECT sum(length(prediction))::BIGINT FROM {source}) AS gen_len, (SELECT count(*) FROM {source}) AS gen_num,
  (SELECT sum({tokens})::BIGINT FROM {source}) AS gen_tok_len, (SELECT round_even(sum({tokens}) / count(*), 1) FROM {source}) AS tokens_per_sample, NULL::VARCHAR AS error"""


def _board_cols(*extra: str) -> str:
    names = {
        "model": "model_name", "scenario": "submission_scenario", "system": "system_name",
        "accelerator": "system_accelerator_name", "total_one": "system_total_accelerators",
        "tokens_per_second": "result_tokens_per_second", "system_price": "system_price_per_hour",
        "cost_per_million": "result_cost_per_million_tokens", "uid": "submission_debug_uid",
    }
    return ", ".join([f"{c} AS {n}" for c, n in names.items()] + list(extra))


def _best(keys: str) -> str:
    return f"QUALIFY row_number() OVER (PARTITION BY {keys} ORDER BY tokens_per_second DESC NULLS LAST, uid DESC) = 1"


_PCT_PERF = "CASE WHEN perf_a = 0 THEN 0 ELSE (tokens_per_second - perf_a) / perf_a * 100 END"
_QUALITY = [
    ("datetime_values", "stamp", _iso), ("frequency_values", "frequency", _frequency),
    ("accelerator_vendors", "accelerator", lambda c: _keyword(c, hw.ACCELERATOR_VENDORS)),
    ("cpu_vendors", "cpu", lambda c: _keyword(c, hw.CPU_VENDORS)),
    ("interconnect_types", "interconnect", _interconnect),
    ("memory:system.accelerator.memory_capacity", "accelerator_memory", _memory),
    ("memory:system.memory.capacity", "host_memory", _memory),
    ("integer:system.accelerator.count_per_node", "per_node", lambda c: f"try_cast({c} AS BIGINT)"),
    ("integer:system.number_of_nodes", "nodes", lambda c: f"try_cast({c} AS BIGINT)"),
]

_LATENCIES = ", ".join(
    f"(k * {n} + {n})::DOUBLE AS {name}"
    for n, name in enumerate(
        [f"p{p}_latency_ns" for p in (50, 90, 99)]
        + [f"{s}_{kind}_ns" for kind in ("first_token_latency", "tpot") for s in ("min", "max", "mean", "p50", "p90", "p95", "p97", "p99", "p99_9")],
        2,
    )
)

STATEMENTS = {
    "aliases_resolved": """
SELECT uid AS submission_debug_uid, organization AS submission_organization, scenario AS submission_scenario,
  result AS metrics_result, units AS metrics_units, model AS model_name, system AS system_name, nodes AS system_number_of_nodes,
  accelerator AS system_cpu_model FROM v_raw""",
    "clean_strings": "SELECT uid, division, accelerator_memory AS memory, model, stamp FROM v_clean",
    "memory_gb": f"SELECT uid, {_memory('accelerator_memory')} AS accelerator_gb, {_memory('host_memory')} AS host_gb FROM v_clean",
    "frequency_ghz": f"SELECT uid, {_frequency('frequency')} AS ghz FROM v_clean",
    "datetime_iso": f"SELECT uid, {_iso('stamp')} AS iso FROM v_raw",
    "interconnect": f"SELECT uid, {_interconnect('interconnect')} AS family FROM v_raw",
    "integer_casts": "SELECT uid, n AS nodes, p AS per_node FROM v_counts",
    "quality_report": "SELECT category, value, count(*) AS rows FROM ("
    + " UNION ALL ".join(
        f"SELECT '{name}' AS category, {c} AS value FROM v_clean WHERE {c} IS NOT NULL AND ({rule(c)}) IS NULL" for name, c, rule in _QUALITY
    )
    + " UNION ALL SELECT 'unpriced_accelerators', accelerator FROM v_clean WHERE accelerator IS NOT NULL AND accelerator NOT IN (SELECT name FROM v_prices)) GROUP BY ALL",
    "accelerator_vendor": f"SELECT uid, {_keyword('accelerator', hw.ACCELERATOR_VENDORS)} AS vendor FROM v_raw",
    "cpu_vendor": f"SELECT uid, {_keyword('cpu', hw.CPU_VENDORS)} AS vendor FROM v_raw",
    "model_params": f"SELECT uid, {_params('model')} AS billions FROM v_raw",
    "model_arch": f"SELECT uid, {_arch('model')} AS architecture FROM v_raw",
    "framework_entries": """
SELECT uid, pos, lower(string_split(item, ' ')[1]) AS name, string_split(item, ' ')[2] AS version FROM (
  SELECT uid, unnest(string_split(framework, ', ')) AS item, CAST(unnest(range(len(string_split(framework, ', ')))) AS INTEGER) AS pos FROM v_raw
) WHERE contains(item, ' ')""",
    "framework_wide": "SELECT uid, " + ", ".join(f"{_framework('framework', n)} AS {n}" for n in ["cuda", "pytorch", "vllm"])
    + f", {_frameworks('framework')} AS versions FROM v_raw",
    "framework_pivot": "SELECT uid, " + ", ".join(f"{_framework('framework', n)} AS fw_{n}" for n in ["cuda", "pytorch", "vllm"])
    + f", {_frameworks('framework')} AS versions FROM v_raw WHERE contains(framework, ' ')",
    "accuracy_entries": """
SELECT uid, lower(string_split(item, ': ')[1]) AS metric, string_split(item, ': ')[2]::DOUBLE AS value
FROM (SELECT uid, unnest(string_split(accuracy, '  ')) AS item FROM v_raw) WHERE contains(item, ': ')""",
    "accuracy_keys": "SELECT DISTINCT lower(string_split(unnest(string_split(accuracy, '  ')), ': ')[1]) AS key FROM v_raw WHERE accuracy IS NOT NULL",
    "total_accelerators_propagate": "SELECT uid, total FROM v_counts",
    "total_accelerators_one": "SELECT uid, total_one AS total FROM v_counts",
    "per_accelerator": "SELECT uid, result / nullif(total, 0) AS per_accelerator FROM v_counts",
    "valid_submissions": "SELECT uid, result, total FROM v_counts WHERE units = 'Tokens/s' AND result <> 0 AND isfinite(result) AND total > 0",
    "etl_full": f"""
SELECT NULL::VARCHAR AS benchmark_name, NULL::VARCHAR AS benchmark_version, {_iso('stamp')} AS datetime, accuracy AS metrics_accuracy,
  result AS metrics_result, result / nullif(n * p, 0) AS metrics_result_per_accelerator, units AS metrics_units,
  {_arch('model')} AS model_architecture, NULL::VARCHAR AS model_mlperf_name, model AS model_name,
  {_params('model')} AS model_number_of_parameters, NULL::VARCHAR AS model_weight_data_types, framework AS software_framework,
  {_framework('framework', 'cuda')} AS software_framework_cuda, {_framework('framework', 'pytorch')} AS software_framework_pytorch,
  {_framework('framework', 'vllm')} AS software_framework_vllm, {_frameworks('framework')} AS software_framework_versions, NULL::VARCHAR AS software_operating_system,
  availability AS submission_availability, uid AS submission_debug_uid, division AS submission_division, organization AS submission_organization,
  scenario AS submission_scenario, p AS system_accelerator_count_per_node, {_memory('accelerator_memory')} AS system_accelerator_memory_capacity,
  NULL::VARCHAR AS system_accelerator_memory_config, accelerator AS system_accelerator_name, n * p AS system_accelerator_total_count,
  {_keyword('accelerator', hw.ACCELERATOR_VENDORS)} AS system_accelerator_vendor, NULL::VARCHAR AS system_cooling,
  NULL::BIGINT AS system_cpu_core_count, NULL::BIGINT AS system_cpu_count_per_node, NULL::VARCHAR AS system_cpu_caches,
  {_frequency('frequency')} AS system_cpu_frequency, cpu AS system_cpu_model, NULL::VARCHAR AS system_cpu_vcpu_count,
  {_keyword('cpu', hw.CPU_VENDORS)} AS system_cpu_vendor, {_interconnect('interconnect')} AS system_interconnect_accelerator,
  NULL::VARCHAR AS system_interconnect_accelerator_host, {_memory('host_memory')} AS system_memory_capacity,
  NULL::VARCHAR AS system_memory_configuration, system AS system_name, n AS system_number_of_nodes, NULL::VARCHAR AS system_type
FROM (SELECT *, try_cast(nodes AS BIGINT) AS n, try_cast(per_node AS BIGINT) AS p FROM v_clean)
WHERE units = 'Tokens/s' AND result <> 0 AND isfinite(result) AND n * p > 0""",
    "results_roundtrip": f"""
SELECT uid, result, {_keyword('accelerator', hw.ACCELERATOR_VENDORS)} AS vendor, {_arch(_clean('model'))} AS architecture,
  {_frameworks('framework')} AS versions
FROM v_counts WHERE units = 'Tokens/s' AND result <> 0 AND isfinite(result) AND total > 0""",
    "price_join": "SELECT uid, unit_price, system_price FROM v_priced",
    "cost_per_million": "SELECT uid, tokens_per_second, cost_per_million, usd_per_million AS usd_per_million_tokens FROM v_board",
    "unpriced_accelerators": "SELECT accelerator AS name, count(*) AS rows FROM v_raw WHERE accelerator IS NOT NULL AND accelerator NOT IN (SELECT name FROM v_prices) GROUP BY 1",
    "price_overrides": """
SELECT coalesce(b.name, o.name) AS name, coalesce(o.price_per_hour, b.price_per_hour) AS price_per_hour, b.price_per_hour AS old_price,
  o.name IS NOT NULL AND o.price_per_hour IS DISTINCT FROM b.price_per_hour AS changed FROM v_prices b FULL JOIN v_overrides o ON b.name = o.name""",
    "price_changes": "SELECT o.name, b.price_per_hour AS old_price, o.price_per_hour FROM v_overrides o LEFT JOIN v_prices b ON b.name = o.name WHERE o.price_per_hour IS DISTINCT FROM b.price_per_hour",
    "dashboard": """
SELECT uid, total_one AS total, system_price, tokens_per_second, cost_per_million,
  try_cast(nullif(regexp_extract(accuracy, 'ROUGE1: (\\d+)', 1), '') AS DOUBLE) AS rouge1 FROM v_board""",
    "kpis": """
SELECT count(DISTINCT system) + max((system IS NULL)::INT) AS systems, count(DISTINCT organization) + max((organization IS NULL)::INT) AS submitters,
  count(DISTINCT accelerator) + max((accelerator IS NULL)::INT) AS accelerators, count(*) AS results, sum(total_one)::BIGINT AS total_accelerators FROM v_board""",
    "model_counts": "SELECT model, count(*) AS count FROM v_raw GROUP BY model",
    "option_lists": "SELECT DISTINCT accelerator FROM v_raw WHERE accelerator IS NOT NULL",
    "overview": """
SELECT NULL::VARCHAR AS benchmark_name, NULL::VARCHAR AS benchmark_version, model AS model_name, system AS system_name,
  accelerator AS system_accelerator_name, total_one AS system_total_accelerators, tokens_per_second AS result_tokens_per_second,
  accuracy AS metrics_accuracy FROM v_board""",
    "performance_view": f"SELECT {_board_cols('coalesce(tokens_per_second / nullif(total_one, 0), CASE WHEN total_one > 0 THEN NULL ELSE 0 END) AS result_tokens_per_accelerator')} FROM v_board {_best('model, scenario, system')}",
    "top_n_systems": """
SELECT row_number() OVER (PARTITION BY model, scenario ORDER BY tokens_per_second DESC NULLS LAST, uid DESC) AS rank, uid, model, scenario, tokens_per_second
FROM v_board QUALIFY rank <= 5""",
    "cost_view": f"SELECT {_board_cols('usd_per_million AS usd_per_million_tokens')} FROM v_board {_best('model, system')}",
    "cost_vs_performance": f"""
SELECT model AS model_name, system AS system_name, accelerator AS system_accelerator_name, total_one AS system_total_accelerators,
  system_price AS system_price_per_hour, tokens_per_second AS result_tokens_per_second, cost_per_million AS result_cost_per_million_tokens
FROM v_board {_best('model, system')}""",
    "pair_compare": f"""
SELECT model, accelerator AS accelerator_b, total_one AS count_b, system AS system_b, tokens_per_second AS tokens_per_second_b,
  system_price AS price_per_hour_b, uid AS uid_b, accelerator_a, count_a, system_a, perf_a AS tokens_per_second_a,
  price_a AS price_per_hour_a, uid_a, perf_a * price_a / 60 AS cost_a, tokens_per_second * system_price / 60 AS cost_b,
  tokens_per_second - perf_a AS perf_delta, system_price - price_a AS price_delta, {_PCT_PERF} AS perf_delta_pct,
  tokens_per_second * system_price / 60 - perf_a * price_a / 60 AS cost_delta,
  CASE WHEN perf_a * price_a / 60 = 0 THEN 0 ELSE (tokens_per_second * system_price / 60 - perf_a * price_a / 60) / nullif(perf_a * price_a / 60, 0) * 100 END AS cost_delta_pct
FROM v_pairs""",
    "cost_sensitivity": """
SELECT model, uid_a, uid_b, ix, iy, x AS price_per_hour, y AS tokens_per_second,
  x / (CASE WHEN coalesce(total_one, 0) = 0 THEN 1 ELSE total_one END) AS unit_price_per_hour,
  y - perf_a AS perf_delta, CASE WHEN perf_a = 0 THEN 0 ELSE (y - perf_a) / nullif(perf_a, 0) * 100 END AS perf_delta_pct,
  x * y / 60 AS cost, d AS cost_delta, CASE WHEN price_a = 0 THEN 0 ELSE d / nullif(price_a, 0) * 100 END AS cost_delta_pct_of_price,
  CASE WHEN price_a * perf_a / 60 = 0 THEN 0 ELSE d / nullif(price_a * perf_a / 60, 0) * 100 END AS cost_delta_pct_of_cost,
  greatest(abs((mx * my - price_a * perf_a) / 60), abs(price_a * perf_a / 60)) AS max_abs_cost_delta
FROM (SELECT *, (x * y - price_a * perf_a) / 60 AS d FROM (
  SELECT *, CASE WHEN ix = 99 THEN mx ELSE ix * (mx / 99) END AS x, CASE WHEN iy = 99 THEN my ELSE iy * (my / 99) END AS y FROM (
    SELECT *, uid AS uid_b, greatest(price_a, system_price) * 1.25::DOUBLE AS mx, greatest(perf_a, tokens_per_second) * 1.25::DOUBLE AS my
    FROM v_pairs WHERE uid = (SELECT min(uid) FROM v_pairs WHERE price_a IS NOT NULL AND system_price IS NOT NULL)),
  (SELECT unnest(range(0, 100))::INT AS ix), (SELECT unnest(range(0, 100))::INT AS iy)))""",
    "select_runs": """
SELECT uid, organization, accelerator FROM v_board WHERE model = 'mixtral-8x7b' AND organization IN ('NATION_1', 'NATION_3', 'NATION_15')
  AND accelerator IN ('TPU-v5e Brand#11', 'speedAI Brand#2', 'NVIDIA H100 Brand#4')""",
    "systems_for": "SELECT uid, system FROM v_board WHERE accelerator = 'TPU-v5e Brand#11' AND total_one = 8",
    "similar_configs": """
SELECT uid, result FROM v_raw WHERE model = 'gptj-99' AND scenario = 'Offline'
  AND result >= 50000::DOUBLE * (1 - 0.1::DOUBLE) AND result <= 50000::DOUBLE * (1 + 0.1::DOUBLE)""",
    "tolerance": """
SELECT uid, CASE WHEN n IS NULL OR p IS NULL THEN n IS NULL AND p IS NULL WHEN n = 0 OR p = 0 THEN n = p
  ELSE abs(n - p) / greatest(abs(n), abs(p)) <= 0.4::DOUBLE END AS near FROM v_counts""",
    "similar_counts": """
, c AS (SELECT model, scenario, accelerator, result, count(*) AS rows FROM v_raw GROUP BY ALL),
s AS (SELECT a.model, a.scenario, a.accelerator, a.result, sum(b.rows)::BIGINT AS n FROM c a JOIN c b ON a.model = b.model AND a.scenario = b.scenario
  AND a.accelerator = b.accelerator AND b.result >= a.result * (1 - 0.1::DOUBLE) AND b.result <= a.result * (1 + 0.1::DOUBLE) GROUP BY ALL)
SELECT c.*, coalesce(s.n, 0) AS similar_rows FROM c LEFT JOIN s USING (model, scenario, accelerator, result)""",
    "request_metrics": "SELECT run_id, valid, completed, total_samples, "
    + ", ".join(f"round({c}, 3) AS {c}" for c in ["samples_per_second", "tokens_per_second", "mean_latency_ns", "p50_latency_ns", "p90_latency_ns", "p99_latency_ns"])
    + " FROM v_run_metrics",
    "successful_requests": "SELECT event_id, run_id, output_tokens FROM v_requests WHERE output_tokens > 0",
    "request_tokens": "SELECT * FROM v_request_tokens",
    "token_latency": "SELECT run_id, requests, "
    + ", ".join(
        f"round({s}_{m}, 0) AS {s}_{m}" for m in ["first_token_latency_ns", "tpot_ns"] for s in ["min", "max", "mean", "p50", "p90", "p95", "p97", "p99", "p99_9"]
    )
    + " FROM v_token_metrics",
    "inter_token": """
SELECT user_id, day, seq, (us - lag(us) OVER w) / 1e6 AS gap_s, CASE WHEN lag(us) OVER w IS NULL THEN (us - start_us) / 1e6 END AS ttft_s
FROM v_chunks WINDOW w AS (PARTITION BY user_id, day ORDER BY us, seq)""",
    "request_fold": """
SELECT user_id, day, (min(us) - min(start_us)) / 1e6 AS ttft_s, count(*) AS output_tokens, string_agg(text, '' ORDER BY us, seq) AS generated_text,
  (count(*) - 1)::INT AS gaps, round((max(us) - min(us)) / 1e6, 6) AS itl_sum FROM v_chunks GROUP BY ALL""",
    "progress": """
SELECT run_id, completed, total, end_us, event_id, completed / total * 100 AS percent FROM (
  SELECT run_id, event_id, end_us, row_number() OVER (PARTITION BY run_id ORDER BY end_us, event_id) AS completed, count(*) OVER (PARTITION BY run_id) AS total
  FROM (SELECT *, epoch_us(ts) + round(latency_s * 1e6)::BIGINT AS end_us FROM v_requests))
WHERE completed = 1 OR completed % greatest(1, total // 10) = 0""",
    "sweep_plan": """
SELECT run_id, m AS max_throughput, point, round_even(point * (m * 1.2::DOUBLE) / 10, 2) AS target_qps FROM (
  SELECT run_id, CASE WHEN samples_per_second > 0 THEN round(samples_per_second, 6) ELSE 500 END AS m, unnest(range(1, 11))::INT AS point FROM v_run_metrics)""",
    "sweep_curve": """
, pts AS (SELECT run_id AS sweep_id, output_tokens // 10 AS step, count(*)::DOUBLE AS n, round(avg(latency_s * 1e9), 0) AS mean_latency_ns FROM v_requests GROUP BY ALL)
SELECT sweep_id, (step + 1)::DOUBLE AS target_qps, CASE WHEN step <> 3 THEN n END AS samples_per_second, mean_latency_ns, step = 3 AS failed,
  CASE WHEN step <> 3 THEN n END / max(CASE WHEN step <> 3 THEN n END) OVER (PARTITION BY sweep_id) AS fraction_of_max FROM pts""",
    "rule_resolution": "SELECT * FROM v_resolved",
    "slo_report": """
, lim AS (SELECT model, scenario, max(value) FILTER (key = 'ttft_latency') AS ttft, max(value) FILTER (key = 'tpot_latency') AS tpot,
  max(value) FILTER (key = 'target_latency' AND value > 0) AS latency FROM v_resolved GROUP BY ALL)
SELECT m.run_id, m.model, m.scenario, 99::DOUBLE AS target_latency_percentile,
  round(p99_first_token_latency_ns / 1e6, 6) AS ttft_ms, ttft AS ttft_limit_ms, round(ttft - p99_first_token_latency_ns / 1e6, 6) AS ttft_margin_ms,
  round(p99_tpot_ns / 1e6, 6) AS tpot_ms, tpot AS tpot_limit_ms, round(tpot - p99_tpot_ns / 1e6, 6) AS tpot_margin_ms,
  round(p99_latency_ns / 1e6, 6) AS latency_ms, latency AS latency_limit_ms, round(latency - p99_latency_ns / 1e6, 6) AS latency_margin_ms,
  (ttft IS NULL OR p99_first_token_latency_ns / 1e6 <= ttft) AND (tpot IS NULL OR p99_tpot_ns / 1e6 <= tpot)
    AND (latency IS NULL OR p99_latency_ns / 1e6 <= latency) AS valid
FROM v_slo_model m LEFT JOIN v_token_metrics t USING (run_id) LEFT JOIN lim ON lim.model = m.model AND lim.scenario = m.scenario""",
    "config_violations": """
, cfg AS (SELECT o_orderkey AS id, o_custkey % 3 AS s, o_orderkey % 4 = 0 AS sweep, o_orderkey % 5 < 2 AS no_rate, o_orderkey % 7 = 0 AS has_batch,
  o_orderkey % 3 AS m, o_orderkey % 11 = 0 AS no_output FROM orders),
v AS (SELECT id, list_filter([
  CASE WHEN m IN (1, 2) AND no_output THEN 'output_column_required' END,
  CASE WHEN s IN (0, 1) AND NOT sweep AND no_rate THEN 'rate_or_sweep_required' END,
  CASE WHEN s = 1 AND has_batch THEN 'server_without_batch_size' END,
  CASE WHEN s = 2 AND m = 1 THEN 'single_stream_without_accuracy' END,
  CASE WHEN sweep AND m IN (1, 2) THEN 'sweep_without_accuracy' END], lambda x: x IS NOT NULL) AS l FROM cfg)
SELECT id AS config_id, len(l)::INT AS n, array_to_string(l, ',') AS violations FROM v""",
    "log_metrics": f"""
SELECT event_id::VARCHAR AS run_id, value AS samples_per_second, k::DOUBLE AS tokens_per_second, k + 0.5::DOUBLE AS mean_latency_ns, {_LATENCIES},
  event_type <> 'error' AS valid, (CASE WHEN k % 2 = 0 THEN k ELSE 0 END)::BIGINT AS completed, k::BIGINT AS total_samples FROM v_events""",
    "log_metrics_strict": f"""
SELECT event_id::VARCHAR AS run_id, value AS samples_per_second, k::DOUBLE AS tokens_per_second, (k || '.5e+06')::DOUBLE AS mean_latency_ns, {_LATENCIES} FROM v_events""",
    "prompt_render": f"""
SELECT sample_idx, family, trim(CASE family
  WHEN 'llama2' THEN '<s>[INST] <<SYS>>' || chr(10) || sys || chr(10) || '<</SYS>>' || chr(10) || chr(10) || input || ' [/INST]'
  WHEN 'llama3' THEN '<|begin_of_text|><|start_header_id|>system<|end_header_id|>' || chr(10) || chr(10) || sys || '<|eot_id|><|start_header_id|>user<|end_header_id|>'
    || chr(10) || chr(10) || input || '<|eot_id|><|start_header_id|>assistant<|end_header_id|>'
  WHEN 'deepseek' THEN sys || chr(10) || chr(10) || input
  ELSE sys || chr(10) || chr(10) || 'Human: ' || input || chr(10) || chr(10) || 'Assistant:' END, {_TRIM}) AS prompt
FROM (SELECT *, coalesce(system_prompt, '') AS sys, CASE WHEN contains(lower(model_path), 'llama2') THEN 'llama2'
  WHEN contains(lower(model_path), 'llama3') THEN 'llama3' WHEN contains(lower(model_path), 'deepseek') THEN 'deepseek' ELSE 'smollm' END AS family FROM v_prompts)""",
    "prompt_fit": f"""
SELECT sample_idx, array_to_string(list_concat(w[1:24], list_transform(range(0, greatest(24 - len(w), 0)), lambda i: '<pad>')), ' ') AS fitted, least(len(w), 24)::INT AS n_tokens
FROM (SELECT sample_idx, list_filter(regexp_split_to_array(trim(input, {_TRIM}), '\\s+'), lambda x: x <> '') AS w FROM v_prompts)""",
    "limited_prompts": "SELECT sample_idx, conv_id, turn FROM v_prompts WHERE sample_idx < 100",
    "prompt_batches": "SELECT sample_idx, conv_id, turn, sample_idx // 64 AS batch_id FROM v_prompts",
    "map_batches": "SELECT sample_idx, len(string_split(input, ' ')) AS words, length(input) AS chars FROM v_prompts",
    "hex_decode": "SELECT log_id, len(ids)::INT AS n, array_to_string(ids, ',') AS ids FROM v_ids",
    "pair_predictions": "SELECT log_id, qsl_idx, reference FROM v_log JOIN v_prompts ON qsl_idx = sample_idx",
    "decode_tokens": "SELECT * FROM v_decoded",
    "rouge_n": ", " + _rouge("v_prompts", "sample_idx") + " SELECT id AS sample_idx, "
    + ", ".join(f"round(max({c}) FILTER (n = {n}), 6) AS rouge{n}_{s}" for n in (1, 2) for c, s in (("prec", "precision"), ("rec", "recall"), ("f1", "f1")))
    + " FROM sc GROUP BY id",
    "rouge_n_stemmed": ", " + _rouge("v_prompts", "sample_idx", stem=True) + " SELECT id AS sample_idx, "
    + ", ".join(f"round(max({c}) FILTER (n = {n}), 6) AS rouge{n}_{s}" for n in (1, 2) for c, s in (("prec", "precision"), ("rec", "recall"), ("f1", "f1")))
    + " FROM sc GROUP BY id",
    "stem_words": ", tok AS (SELECT regexp_extract_all(lower(text), '[a-z0-9]+') AS r, regexp_extract_all(lower(text), '[a-z0-9]+') AS p FROM conversations), "
    + _stems() + " SELECT word, stem FROM stems",
    # One row of the table of common subsequence lengths after another, by a fold over the prediction.
    "rouge_l": """
, tok AS (SELECT sample_idx AS id, regexp_extract_all(lower(reference), '[a-z0-9]+') AS r, regexp_extract_all(lower(prediction), '[a-z0-9]+') AS p FROM v_prompts),
lcs AS (SELECT id, len(r) AS nr, len(p) AS np, coalesce(list_reduce(list_transform(p, lambda t: list_transform(r, lambda x: (x = t)::BIGINT)),
  lambda acc, hit: list_transform([list_transform(range(1, len(acc) + 1), lambda j: CASE WHEN hit[j] = 1 THEN coalesce(acc[j - 1], 0) + 1 ELSE acc[j] END)],
    lambda c: list_transform(range(1, len(c) + 1), lambda j: list_max(c[1:j])))[1],
  list_transform(r, lambda x: 0::BIGINT))[-1], 0) AS h FROM tok),
pr AS (SELECT id, coalesce(h / nullif(np, 0), 0) AS prec, coalesce(h / nullif(nr, 0), 0) AS rec FROM lcs)
SELECT id AS sample_idx, round(prec, 6) AS rougeL_precision, round(rec, 6) AS rougeL_recall,
  round(coalesce(2 * prec * rec / nullif(prec + rec, 0), 0), 6) AS rougeL_f1 FROM pr""",
    "sentence_lines": f"""
SELECT sample_idx, regexp_replace(trim(input, {_TRIM}), '([.!?])\\s+', '\\1' || chr(10), 'g') AS input,
  regexp_replace(trim(reference, {_TRIM}), '([.!?])\\s+', '\\1' || chr(10), 'g') AS reference FROM v_prompts""",
    "corpus_accuracy": ", " + _rouge("v_prompts", "sample_idx") + """
SELECT round_even(avg(f1) FILTER (n = 1) * 100, 4) AS rouge1, round_even(avg(f1) FILTER (n = 2) * 100, 4) AS rouge2,
  (SELECT sum(length(prediction))::BIGINT FROM v_prompts) AS gen_len, (SELECT count(*) FROM v_prompts) AS gen_num,
  (SELECT sum(len(string_split(prediction, ' ')))::BIGINT FROM v_prompts) AS gen_tok_len,
  (SELECT round_even(sum(len(string_split(prediction, ' '))) / count(*), 1) FROM v_prompts) AS tokens_per_sample, NULL::VARCHAR AS error FROM sc""",
    "accuracy_evaluation": ", " + _rouge("v_samples", "id") + """
SELECT round_even(avg(f1) FILTER (n = 1) * 100, 4) AS rouge1, round_even(avg(f1) FILTER (n = 2) * 100, 4) AS rouge2,
  (SELECT sum(length(prediction))::BIGINT FROM v_samples) AS gen_len, (SELECT count(*) FROM v_samples) AS gen_num,
  (SELECT sum(n_tokens)::BIGINT FROM v_samples) AS gen_tok_len,
  (SELECT round_even(sum(n_tokens) / count(*), 1) FROM v_samples) AS tokens_per_sample, NULL::VARCHAR AS error FROM sc""",
    "rouge_lsum": ", " + _rouge("v_prompts", "sample_idx") + _subsequences("v_prompts", "sample_idx") + """
SELECT id AS sample_idx, round(prec, 6) AS "rougeLsum_precision", round(rec, 6) AS "rougeLsum_recall", round(f1, 6) AS "rougeLsum_f1" FROM lsc WHERE name = 'Lsum'""",
    "score_samples": ", " + _rouge("v_prompts", "sample_idx", stem=True) + _subsequences("v_prompts", "sample_idx", stem=True) + _FOUR + f"""
SELECT sample_idx, {_lines('reference')} AS reference, {_lines('prediction')} AS prediction, rouge1, rouge2, "rougeL", "rougeLsum"
FROM v_prompts JOIN f1s ON f1s.id = sample_idx JOIN fls ON fls.id = sample_idx""",
    "accuracy_details": ", " + _rouge("v_samples", "id", stem=True) + _subsequences("v_samples", "id", stem=True) + _FOUR + f"""
SELECT s.id AS log_id, qsl_idx, {_lines('prediction')} AS prediction, n_tokens, rouge1, rouge2, "rougeL", "rougeLsum"
FROM v_samples s JOIN v_log ON log_id = s.id JOIN f1s ON f1s.id = s.id JOIN fls ON fls.id = s.id""",
    "corpus_accuracy_full": ", " + _rouge("v_prompts", "sample_idx", stem=True) + _subsequences("v_prompts", "sample_idx", lines=False, stem=True)
    + _record("v_prompts", "len(string_split(prediction, ' '))"),
    "accuracy_evaluation_full": ", " + _rouge("v_samples", "id", stem=True) + _subsequences("v_samples", "id", stem=True) + _record("v_samples", "n_tokens"),
    "run_merge": "SELECT run_id, samples_per_second, scenario, rouge1, mode, gen_num FROM v_merged",
    "run_files": """
WITH f AS (
  SELECT *, o_orderkey AS k, o_orderkey % 3 <> 0 AND o_orderkey % 11 <> 0 AS p, o_orderkey % 2 = 0 AND o_orderkey % 13 <> 0 AS a,
    o_orderkey % 4 = 0 AND o_orderkey % 17 <> 0 AS r FROM orders WHERE o_orderkey % 3 <> 0 OR o_orderkey % 2 = 0
)
SELECT lpad(k::VARCHAR, 10, '0') || '-1' AS run_id, CASE WHEN p AND k % 10 <> 1 THEN o_totalprice WHEN a THEN o_totalprice / 2 END AS samples_per_second,
  CASE WHEN p THEN o_orderstatus WHEN a THEN 'Offline' END AS scenario,
  CASE WHEN p AND (a OR r) THEN 'PerformanceAndAccuracy' WHEN p THEN 'PerformanceOnly' WHEN a OR r THEN 'AccuracyOnly' END AS mode,
  NULL::VARCHAR AS datetime, CASE WHEN p AND k % 5 <> 0 THEN k END AS gen_len, CASE WHEN p THEN o_orderpriority WHEN a THEN 'acc' END AS gpu,
  CASE WHEN p AND k % 5 = 0 THEN k || '.5' END AS gen_len_text, CASE WHEN p AND k % 7 = 0 THEN o_totalprice * 2 END AS max_throughput,
  CASE WHEN p AND k % 7 = 0 THEN '[{"target_qps":' || k || '}]' END AS sweep_results, CASE WHEN a THEN 'n' END AS note,
  CASE WHEN r THEN (k % 100)::DOUBLE END AS rouge1, CASE WHEN r THEN k % 9 + 0.5 END::DOUBLE AS gen_num FROM f""",
    "run_directories": f"""
WITH s AS (SELECT s_suppkey AS k, s_name, s_acctbal, s_suppkey % 5 <> 0 AND s_suppkey % 3 <> 0 AS p, s_suppkey % 5 <> 0 AND s_suppkey % 2 = 0 AS a,
  s_suppkey % 5 <> 0 AND s_suppkey % 4 = 0 AS r, {_STAMP} AS t FROM supplier)
SELECT strftime(t, '%Y%m%d-%H%M%S') AS run_id, CASE WHEN p THEN s_acctbal WHEN a THEN s_acctbal / 2 END AS samples_per_second,
  CASE WHEN p THEN s_name WHEN a THEN 'late' END AS scenario, CASE WHEN a THEN (k % 100)::DOUBLE END AS rouge1,
  CASE WHEN p AND (a OR r) THEN 'PerformanceAndAccuracy' WHEN p THEN 'PerformanceOnly' WHEN a OR r THEN 'AccuracyOnly' END AS mode,
  strftime(t, '%Y-%m-%dT%H:%M:%S') AS datetime, CASE WHEN r THEN (k % 7)::DOUBLE END AS result_rouge1
FROM s WHERE k % 5 < 2 OR p OR a OR r""",
    "experiments": f"""
WITH s AS (SELECT s_suppkey AS k, s_name, s_suppkey % 4 <> 0 AS held, s_suppkey % 4 <> 0 AND s_suppkey % 11 <> 0 AS m, s_suppkey % 6 <> 1 AS i,
  {_STAMP} AS t FROM supplier)
SELECT 'exp' || k AS experiment, CASE WHEN i THEN 'step-1' END AS step, CASE WHEN i THEN 'run ' || s_name END AS cmd,
  CASE WHEN i THEN strftime(t, '%Y-%m-%dT%H:%M:%S') END AS datetime, CASE WHEN m THEN s_name END AS alias, CASE WHEN m THEN md5(s_name) END AS meta_uid,
  CASE WHEN m THEN s_name END AS owner, CASE WHEN m THEN 'imported' END AS meta_tags, CASE WHEN i THEN (k % 9)::VARCHAR END AS input_version
FROM s WHERE i OR held""",
    "union_runs": """
SELECT 'published' AS source, 'pub' || c_custkey AS run_id, c_acctbal AS samples_per_second, c_mktsegment AS segment, NULL AS mode FROM customer
UNION ALL SELECT 'local', run_id, samples_per_second, NULL, mode FROM v_merged""",
    "run_summary": "SELECT count(*) AS total_runs, count(samples_per_second) AS performance_runs, count(*) FILTER (has_results) AS accuracy_runs FROM v_merged",
    "ordered_runs": "SELECT run_id, mode FROM v_merged ORDER BY run_id",
    "stream_metrics": """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS window_start, count(*) FILTER (output_tokens > 0) AS completed, count(*) AS total_samples,
  round(count(*) FILTER (output_tokens > 0) / (max(epoch_us(ts) / 1e6 + latency_s) - min(epoch_us(ts) / 1e6)), 3) AS samples_per_second,
  round(sum(prompt_len + output_tokens) FILTER (output_tokens > 0) / (max(epoch_us(ts) / 1e6 + latency_s) - min(epoch_us(ts) / 1e6)), 3) AS tokens_per_second,
  round(avg(latency_s * 1e9) FILTER (output_tokens > 0), 3) AS mean_latency_ns,
  round(quantile_disc(latency_s * 1e9, 0.5) FILTER (output_tokens > 0), 3) AS p50_latency_ns,
  round(quantile_disc(latency_s * 1e9, 0.9) FILTER (output_tokens > 0), 3) AS p90_latency_ns,
  round(quantile_disc(latency_s * 1e9, 0.99) FILTER (output_tokens > 0), 3) AS p99_latency_ns
FROM v_requests GROUP BY 1""",
    "stream_token_sessions": "SELECT user_id, day, ttft_s, latency_s, output_tokens, tpot_s FROM v_request_tokens",
    "stream_tokens": """
SELECT user_id, day, ttft_s, latency_s, output_tokens, tpot_s, 'timeout' AS closed_by FROM v_request_tokens
WHERE day * 86400000 + floor(latency_s * 1000) + 4200000 <= (SELECT epoch_us(max(ts)) // 1000 FROM v_events)""",
}


def _needed(text: str, seen: list[str]) -> list[str]:
    for name in VIEWS:
        if name not in seen and re.search(rf"\b{name}\b", text):
            _needed(VIEWS[name], seen)
            seen.append(name)
    return seen


def statement(body: str) -> str:
    """A full statement: the views it needs, then the body (which may add its own, after a comma)."""
    ctes = ", ".join(f"{n} AS ({VIEWS[n].strip()})" for n in _needed(body, []))
    body = body.strip()
    if body.startswith(","):
        return f"WITH {ctes}{body}" if ctes else f"WITH {body[1:]}"
    return f"WITH {ctes} {body}" if ctes else body


ORACLE = {name: statement(body) for name, body in STATEMENTS.items()}
