"""Packing plans on dense and sparse length tables; the word encoder against the tokenizer."""

import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from inferlytics.llm import packing


def tables(limit):
    rng = random.Random(limit)
    yield "dense", {x: rng.randrange(1, 10**6) for x in range(1, limit + 1)}
    yield "long", {x: rng.randrange(1, 10**6) for x in range(limit // 3, limit + 1)}
    yield "sparse", {x: rng.randrange(1, 10) for x in rng.sample(range(1, limit + 1), limit // 3)}
    yield "few", {x: rng.randrange(1, 3) for x in range(1, limit + 1)}
    yield "short", {x: 10**7 // (x + 10) + rng.randrange(50) for x in range(1, limit + 1)}
    yield "falling", {x: 1 + int(rng.random() * 10**5 * 2.7 ** (-6 * x / limit)) for x in range(1, limit + 1)}


def best_fit_alone(histogram, limit):
    counts = [0] * (limit + 1)
    for length, n in histogram.items():
        counts[length] = n
    sequences = packing._Sequences(limit)
    sequences.best_fit(counts, limit, 1)
    return sum(n for groups in sequences.groups.values() for _, n in groups)


@pytest.mark.parametrize("limit", [64, 512, 1024, 4096])
def test_never_above_best_fit_alone_and_quick(limit):
    for name, histogram in tables(limit):
        start = time.process_time()
        patterns = packing.plan(histogram, limit)
        assert time.process_time() - start < 5, name
        used = Counter()
        for parts, n in patterns:
            assert sum(parts) <= limit and n > 0
            for x in parts:
                used[x] += n
        assert used == histogram, name
        total = sum(n for _, n in patterns)
        assert total <= best_fit_alone(histogram, limit), name
        assert total >= -(-sum(x * n for x, n in histogram.items()) // limit), name


def test_gaps_are_filled_by_one_two_and_three():
    patterns = packing.plan({60: 3, 40: 1, 22: 1, 18: 1, 20: 1, 15: 1, 5: 1}, 100, small=40)
    assert sorted(patterns) == [((60, 20, 15, 5), 1), ((60, 22, 18), 1), ((60, 40), 1)]


def test_index_finds_every_combination():
    rng = random.Random(2)
    for _ in range(30):
        counts = [0] + [rng.randrange(3) for _ in range(20)]
        sums = packing._Sums(list(counts), 20)
        there = [x for x, n in enumerate(counts) if n]
        for gap in range(1, 21):
            assert set(sums.pairs(gap)) == {(a, b) for a in there for b in there if b <= a and a + b == gap}
            assert set(sums.triples(gap)) == {(a, b, c) for a in there for b in there for c in there if c <= b <= a and a + b + c == gap}


@pytest.mark.parametrize("capacity", [50, 10**6])
def test_encoder_equals_tokenizer(capacity):
    import public_tokenizers

    rng = random.Random(4)
    bits = ["a", "word", "Über", "é", "é", "l'heure", "don't", "'s", "12", "|", "||", "$$$", ".", "-", "<|endoftext|>", "<|", "ß", "İ", "Σ", "中", "\x85", "\x1c", "_", "😀"]
    texts = ["".join(rng.choice([*bits, " ", "\n"]) for _ in range(rng.randrange(30))) for _ in range(600)] + ["", " "]
    encoder = packing.WordEncoder(public_tokenizers.path(packing.TOKENIZER), capacity)
    for text, ids in zip(texts, encoder.encode(pa.array(texts), together=40), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == [*encoder.tokenizer.encode(text, add_special_tokens=False).ids, 1], repr(text)
