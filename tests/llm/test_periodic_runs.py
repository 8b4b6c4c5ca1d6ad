"""Periodic runs against the definition on small texts."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from inferlytics.llm import periodic_runs

SCHEMA = "doc_id long, text string, runs string, start long, n_words int"


def plain_runs(w):
    """All stretches, tested one by one."""
    n, out = len(w), []
    for a in range(n):
        for b in range(a + 6, n + 1):
            period = next(q for q in range(1, b - a + 1) if all(w[i] == w[i - q] for i in range(a + q, b)))
            if b - a < 4 * period:
                continue
            if (a and w[a - 1] == w[a - 1 + period]) or (b < n and w[b] == w[b - period]):
                continue
            out.append((a, b - a, period))
    return sorted(out, key=lambda r: (r[0], r[2]))


def fast_runs(w):
    """Every lag by itself; of equal stretches the smallest lag."""
    found = {}
    for q in range(len(w) // 4, 0, -1):
        i = q
        while i < len(w):
            j = i
            while j < len(w) and w[j] == w[j - q]:
                j += 1
            if j - i + q >= max(6, 4 * q):
                found[i - q, j - i + q] = q
            i = j + 1
    return sorted(((a, n, q) for (a, n), q in found.items()), key=lambda r: (r[0], r[2]))


def detected(w):
    names = {x: k for k, x in enumerate(dict.fromkeys(w))}
    return [tuple(r) for r in periodic_runs.runs_of(np.array([names[x] for x in w], np.int64), np.array([0, len(w)])).tolist()]


@pytest.mark.parametrize("letters", [1, 2, 3, 5])
def test_runs_equal_definition(letters):
    rng = random.Random(letters)
    for _ in range(60):
        w = [rng.randrange(letters) for _ in range(rng.randrange(0, 34))]
        assert detected(w) == plain_runs(w) == fast_runs(w)


def test_nested_and_touching_runs_equal_definition():
    rng = random.Random(5)
    for _ in range(300):
        w = []
        while len(w) < 150:
            cycle = [rng.randrange(3) for _ in range(rng.randrange(1, 9))]
            piece = (cycle * 12)[: rng.randrange(1, 12 * len(cycle))]
            w += piece if rng.random() < 0.7 else (piece[:5] + [7]) * rng.randrange(1, 6)
        assert detected(w) == fast_runs(w)


def test_many_documents_at_once_equal_each_alone():
    rng = random.Random(9)
    texts = [[rng.randrange(2) for _ in range(rng.choice([0, 1, 5, 6, 30, 200]))] for _ in range(50)]
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    runs = periodic_runs.runs_of(np.array([x for t in texts for x in t], np.int64), bounds)
    got = {k: [] for k in range(len(texts))}
    for a, n, q in runs.tolist():
        k = int(np.searchsorted(bounds, a, "right")) - 1
        got[k].append((a - int(bounds[k]), n, q))
    assert got == {k: fast_runs(t) for k, t in enumerate(texts)}


def test_one_word_a_million_times_is_one_run():
    assert detected([0] * 1_000_000) == [(0, 1_000_000, 1)]
    assert detected([0, 1, 2] * 300_000) == [(0, 900_000, 3)]


def expected(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g = h // 10
        a = g % len(w)
        p = 1 + (len(w) - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
    runs = fast_runs(w)
    best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
    dropped = {i for a, n, q in runs for i in range(a + q, a + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{a},{n},{q}\n" for a, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in dropped)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(kept))


def test_query_equals_definition(spark, tmp_path):
    rng = random.Random(3)
    texts = [None, "", " \t\n ", "a", "a " * 7, "\x0b\x0cb a\x1cc a\x85c é é é é é é \r\n", "x y " * 30 + "z " + "x y " * 30, "1 " * 20000]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randrange(200))) for _ in range(150)]
    rows = [(k, t, "x", 1, 2) for k, t in enumerate(texts)] + [(6, texts[6], "x", 1, 2)] * 2 + [(None, "a " * 9, None, None, None), (None,) * 5]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((tuple(r) for r in periodic_runs.query(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted((expected(r[0], r[1]) for r in rows), key=repr)


def test_general_form(spark):
    frame = spark.createDataFrame([(1, "go a b a b a b a b stop"), (2, "plain words"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in periodic_runs.find_runs(frame).collect()}
    assert got[1]["collapsed"] == "go a b stop" and [tuple(x) for x in got[1]["runs"]] == [(1, 8, 2)] and got[1]["n_words"] == 10
    assert got[2]["collapsed"] == "plain words" and got[2]["runs"] == [] and got[3]["collapsed"] == ""
    assert periodic_runs.find_runs(frame.limit(0)).count() == 0
