"""Batched subsequences against the full table, pair by pair."""

import random
from collections import Counter

import numpy as np
import pytest

from inferlytics.functions import subsequences as sub


def table(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t


def path(a, b):
    t, i, j, found = table(a, b), len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif t[i][j - 1] > t[i - 1][j]:
            j -= 1
        else:
            i -= 1
    return found


def sentences(tokens):
    out = [[]]
    for t in tokens:
        out.append([]) if t == 0 else out[-1].append(t)
    return out


def plain(a, b):
    long = table([t for t in a if t], [t for t in b if t])[-1][-1]
    marked, there, total = Counter(), Counter(t for t in b if t), 0
    for s in sentences(a):
        for i in {i for other in sentences(b) for i in path(s, other)}:
            marked[s[i]] += 1
    return long, sum(min(n, there[t]) for t, n in marked.items()) + total


def laid(rows):
    return np.array([t for r in rows for t in r], np.int64), np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)


@pytest.mark.parametrize("longest,letters,words,cells", [(12, 4, 8, 1 << 20), (90, 3, 8, 300), (200, 20, 8, 1 << 20), (200, 3, 1, 5000), (40, 2, 0, 1 << 20)])
def test_hits_equal_the_table(longest, letters, words, cells, monkeypatch):
    monkeypatch.setattr(sub, "WORDS", words)
    monkeypatch.setattr(sub, "CELLS", cells)
    rng = random.Random(longest + words)

    def text():
        return [0 if rng.random() < 0.06 else rng.randrange(1, letters + 1) for _ in range(rng.randrange(longest))]

    rows = [(text(), text()) for _ in range(60)] + [([], []), ([], [1]), ([1], []), ([0, 0], [0]), ([1, 0, 1], [0, 1])]
    long, union = sub.hits(laid([a for a, _ in rows]), laid([b for _, b in rows]), 0)
    for k, (a, b) in enumerate(rows):
        assert (long[k], union[k]) == plain(a, b), (a, b)


def test_no_rows():
    long, union = sub.hits(laid([]), laid([]), 0)
    assert len(long) == len(union) == 0


def test_carries_cross_words():
    a = [1] * 300
    long, union = sub.hits(laid([a, a]), laid([[1] * 257, [2] + [1] * 127 + [2]]), 0)
    assert long.tolist() == union.tolist() == [257, 127]
