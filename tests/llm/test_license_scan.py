"""License scans against every block and every template, on small texts."""

import random
import re

import pytest

from inferlytics.llm import license_scan as ls

SCHEMA = "doc_id long, text string, labels string, row long, size int, score double"
SEPARATORS = [" ", "\n", ". ", " (", '"\t', "-"]


def plain(doc_id, text, templates, threshold):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    base = [(i, label) for p, label in ls.PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
    found, score = {label for _, label in base}, 0.0
    for label, notice in templates:
        t = ls.words_of(notice)
        c = 1
        while c < len(t):
            c *= 2
        for at in range(0, len(w), c):
            share = len(set(t) & set(w[at : at + 2 * c])) / len(set(t))
            if share >= threshold - 1e-12:
                found.add(label)
                score = max(score, share)
    places = [i for i, _ in base]
    names = ",".join(sorted({label for _, label in base}))
    return (doc_id, len(w), len(base), min(places, default=None), max(places, default=None), names, ",".join(sorted(found)), score)


def scanned(spark, rows, templates=ls.TEMPLATES, threshold=ls.THRESHOLD):
    frame = spark.createDataFrame([(*r, "x", 1, 2, 0.5) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in ls.scan(frame, templates=templates, threshold=threshold).collect()), key=repr)


def check(spark, rows, templates=ls.TEMPLATES, threshold=ls.THRESHOLD):
    assert scanned(spark, rows, templates, threshold) == sorted((plain(*r, templates, threshold) for r in rows), key=repr)


def test_odd_texts_equal_definition(spark):
    texts = [None, "", " \n", "MIT license", "mit LICENSE mit license\x0bMİT License", "gnu general public license gnu general public", "cc by cc by-nc 4.0 x cc  by"]
    texts += ["xmit license", "mit licensex", "é mit license ß", "Released under the MIT\nLicense.", "mit " * 20000, "𝒜mit license", "apache--license, apache_license apache license2"]
    rows = [(k, t) for k, t in enumerate(texts)] + [(4, texts[4])] * 2 + [(None, texts[3]), (None, None)]
    check(spark, rows)
    assert scanned(spark, []) == []


def test_notices_with_edits_equal_definition(spark):
    rng = random.Random(1)
    rows = []
    for k in range(150):
        words = ls.words_of(rng.choice(ls.TEMPLATES)[1])
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(words))
            words[at : at + rng.randrange(2)] = rng.choice([[], ["odd"], [rng.choice(words)]])
        filler = [f"w{rng.randrange(50)}" for _ in range(rng.randrange(120))]
        at = rng.randrange(len(filler) + 1)
        rows.append((k, "".join(x + rng.choice(SEPARATORS) for x in [*filler[:at], *words, *filler[at:]])))
    check(spark, rows)


@pytest.mark.parametrize("threshold", [0.34, 0.5, 0.75, 1.0])
def test_filters_lose_no_match(spark, threshold):
    rng = random.Random(int(100 * threshold))
    names = [f"{c}{i}" for i, c in enumerate("abcdefghijklmnop")]
    templates = [(f"t{k}", " ".join(rng.choice(names) for _ in range(rng.choice([1, 2, 3, 5, 8, 9, 17])))) for k in range(12)]
    weights = [2.0**-i for i in range(len(names))]
    rows = [(k, " ".join(rng.choices([*names, "other"], [*weights, 0.5], k=rng.randrange(60)))) for k in range(120)]
    check(spark, rows, templates, threshold)


def test_no_python_on_the_path(spark):
    frame = spark.createDataFrame([(1, "Released under the MIT License")], "doc_id long, text string")
    plan = ls.scan(frame)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    with pytest.raises(ValueError):
        ls.prepared([("none", "-- --")])
