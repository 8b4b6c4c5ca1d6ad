"""Vector codes against exhaustive search on small tables."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inferlytics.llm import vector_codes


def plain(rows, parts=8, entries=16, rounds=6):
    """The definition, with Python's whole numbers and no search structure."""
    kept = [(k, label, v) for k, v, label in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    per = max(1, -(-max(len(v) for _, _, v in kept) // parts))
    whole = [[int(np.floor(x * 4096)) for x in v] + [0] * (parts * per - len(v)) for _, _, v in kept]
    cut = [[v[p * per : (p + 1) * per] for p in range(parts)] for v in whole]
    order = sorted(range(len(kept)), key=lambda i: (kept[i][0] is None, kept[i][0] or 0, whole[i]))[:entries]
    books = [[cut[i][p] for i in order] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    find = lambda: [[min((far(c[p], e), j) for j, e in enumerate(books[p])) for p in range(parts)] for c in cut]
    for _ in range(rounds):
        best = find()
        for p in range(parts):
            for j in range(len(order)):
                mine = [cut[i][p] for i in range(len(kept)) if best[i][p][1] == j]
                if mine:
                    books[p][j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = [(k, label, "".join(f"{j:02x}" for _, j in b), sum(d for d, _ in b)) for (k, label, _), b in zip(kept, find(), strict=True)]
    sums = {label: sum(o[3] for o in out if o[1] == label) for _, label, _, _ in out}
    return sorted(((k, code, e, sums[label], sha) for k, label, code, e in out), key=repr)


SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, part int, n long"


def coded(spark, rows):
    extra = ("x", 1, 2, 3)
    frame = spark.createDataFrame([(*r, *extra) for r in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in vector_codes.compress(frame, F.col("label")).collect()), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_equals_definition(spark, seed):
    rng = random.Random(seed)
    values = [-0.5, -0.25, -0.0001, 0.0, 0.0001, 0.25, 0.5] if seed else [rng.uniform(-1, 1) for _ in range(500)]
    rows = [(k, [rng.choice(values) for _ in range(16)], rng.choice([None, 0, 1])) for k in range(120)]
    rows += [(k, rows[3][1], 0) for k in (3, 3, 7, 500)]  # repeats of a row, an id with two vectors, copies
    rows += [(None, [0.1] * 16, None), (600, None, 1), (601, [0.1, None], 1), (602, [float("nan")] * 16, 1), (603, [float("inf")], 1)]
    rows += [(604, [], 2), (605, [0.3] * 5, 2), (606, [30000.0, -30000.0], 3)]
    rng.shuffle(rows)
    assert coded(spark, rows) == plain(rows)


def test_few_rows_equal_rows_and_none(spark):
    one = [(5, [0.1, 0.2, 0.3], None)]
    assert coded(spark, one) == plain(one)
    same = [(k % 4, [0.5] * 8, k % 2) for k in range(40)]
    assert coded(spark, same) == plain(same) and {r[1] for r in coded(spark, same)} == {"00" * 8}
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_huge_components_do_not_fail(spark):
    rows = [(1, [1e30, -1e30], 0), (2, [3e38, 0.0], 0), (3, [-1e300, 5e-324], None)]
    got = coded(spark, rows)
    assert [r[0] for r in got] == [1, 2, 3] and all(r[2] >= 0 for r in got)


@pytest.mark.parametrize("spread", [3, 40, 10**6])
def test_search_equals_exhaustive_search(spread):
    rng = np.random.default_rng(spread)
    for n in (1, 2, 16, 40):
        entries = rng.integers(-spread, spread + 1, (n, 4))
        entries[n // 2] = entries[0]  # equal entries
        points = np.concatenate([rng.integers(-2 * spread, 2 * spread + 1, (300, 4)), entries])
        at, best = vector_codes.Orchard(entries).nearest(points)
        far = ((points[:, None] - entries[None]) ** 2).sum(2)
        assert (at == far.argmin(1)).all() and (best == far.min(1)).all()
