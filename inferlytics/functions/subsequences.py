"""Longest common subsequences of many pairs at once, bit-parallel in 64-bit words.

Tokens are numbers, a pair's table of common lengths is a row of bits per token of the first text (bit j clear: token j+1
of the second text adds one), and a step takes one token of every pair of a block. Python loops over steps and words, not
over pairs. Second texts of more than ``WORDS`` words of bits, where a pair alone keeps the machine busy, use whole numbers
of any size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

WORDS = 8
CELLS = 1 << 20  # words of bits in a block's table
ONE = np.uint64(1)


class Texts:
    """Token numbers laid end to end, cut into segments."""

    def __init__(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray):
        self.tokens, self.starts, self.sizes = tokens, starts, sizes

    def places(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all tokens of these segments, and the number in ``which`` that each belongs to."""
        sizes = self.sizes[which]
        owner = np.repeat(np.arange(len(which)), sizes)
        first = np.cumsum(sizes) - sizes
        return np.arange(len(owner)) - first[owner] + self.starts[which][owner], owner


def _full(sizes: np.ndarray, words: int) -> np.ndarray:
    """Rows with the lowest ``sizes`` bits set."""
    left = np.clip(sizes[:, None] - 64 * np.arange(words), 0, 64)
    some = np.where(left < 64, (ONE << (left % 64).astype(np.uint64)) - ONE, ~np.uint64(0))
    return some.astype(np.uint64)


def _blocks(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(words, pairs) of pairs alike in size; words is 0 for those that are handled alone."""
    words = (b.sizes[right] + 63) // 64
    words[words > WORDS] = 0
    order = np.lexsort((-a.sizes[left], words))
    order = order[(a.sizes[left[order]] > 0) & (b.sizes[right[order]] > 0)]
    cells = (a.sizes[left[order]] + 1) * np.maximum(words[order], 1)
    group = np.cumsum(cells) // CELLS
    cuts = np.flatnonzero((np.diff(group) > 0) | (np.diff(words[order]) > 0)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(words[part[0]]), part


def _table(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray, words: int, keep: bool) -> list[np.ndarray]:
    """Bit rows (pairs, words) after each token of the first texts; of all steps, or the last one only. Longest first."""
    kinds = int(max(a.tokens.max(initial=0), b.tokens.max(initial=0))) + 1
    at, owner = b.places(right)
    keys, inverse = np.unique(owner * kinds + b.tokens[at], return_inverse=True)
    masks = np.zeros((len(keys) + 1, words), np.uint64)  # the last row: tokens that the second text lacks
    place = at - b.starts[right][owner]
    np.bitwise_or.at(masks, (inverse, place // 64), ONE << (place % 64).astype(np.uint64))
    at, owner = a.places(left)
    asked = owner * kinds + a.tokens[at]
    met = np.searchsorted(keys, asked)
    met[keys[np.minimum(met, len(keys) - 1)] != asked] = len(keys)
    sizes = a.sizes[left]
    first = np.cumsum(sizes) - sizes
    full = _full(b.sizes[right], words)
    row, rows = full.copy(), [full]
    for step in range(int(sizes.max(initial=0))):
        alive = int(np.searchsorted(-sizes, -step, "left"))  # sizes fall
        now, hit = row[:alive], row[:alive] & masks[met[first[:alive] + step]]
        total, carry = np.empty_like(now), np.zeros(alive, np.uint64)
        for w in range(words):
            part = now[:, w] + hit[:, w]
            total[:, w] = part + carry
            carry = ((part < now[:, w]) | (total[:, w] < part)).astype(np.uint64)
        row = row.copy() if keep else row
        row[:alive] = (total | (now ^ hit)) & full[:alive]
        if keep:
            rows.append(row)
    return rows if keep else [row]


def lengths(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Length of the longest common subsequence of segments ``left`` of ``a`` and ``right`` of ``b``, pair by pair."""
    out = np.zeros(len(left), np.int64)
    for words, part in _blocks(a, b, left, right):
        if words:
            row = _table(a, b, left[part], right[part], words, False)[0]
            out[part] = b.sizes[right[part]] - np.bitwise_count(row).sum(1)
        else:
            for k in part.tolist():
                x, y = _lists(a, b, left[k], right[k])
                out[k] = len(y) - bit_rows(x, y)[-1].bit_count()
    return out


def matched(a: Texts, b: Texts, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each token of ``a`` whether one longest common subsequence of some pair takes it.

    The path goes back from the end: along a match, else to the shorter second text if only that keeps the length.
    """
    mark = np.zeros(len(a.tokens), bool)
    for words, part in _blocks(a, b, left, right):
        if not words:
            for k in part.tolist():
                mark[a.starts[left[k]] + np.array(positions(*_lists(a, b, left[k], right[k])), np.int64)] = True
            continue
        rows = np.stack(_table(a, b, left[part], right[part], words, True))
        first, second = a.starts[left[part]], b.starts[right[part]]
        i, j = a.sizes[left[part]].copy(), b.sizes[right[part]].copy()
        live = np.arange(len(part))
        while len(live):
            x, y = i[live], j[live]
            same = a.tokens[first[live] + x - 1] == b.tokens[second[live] + y - 1]
            mark[(first[live] + x - 1)[same]] = True
            low = _full(y, words)
            ones = [np.bitwise_count(rows[at, live] & low).sum(1) for at in (x, x - 1)]
            back = ones[0] < ones[1]  # the row above is shorter by one, so only stepping left keeps the length
            i[live] -= same | ~back
            j[live] -= same | back
            live = live[(i[live] > 0) & (j[live] > 0)]
    return mark


def _lists(a: Texts, b: Texts, k: int, m: int) -> tuple[list[int], list[int]]:
    return (
        a.tokens[a.starts[k] : a.starts[k] + a.sizes[k]].tolist(),
        b.tokens[b.starts[m] : b.starts[m] + b.sizes[m]].tolist(),
    )


def bit_rows(a: list, b: list) -> list[int]:
    """Bit rows of one pair as whole numbers: bit j of row i is clear where column j+1 of ``b`` adds one."""
    where: dict = {}
    for j, token in enumerate(b):
        where[token] = where.get(token, 0) | (1 << j)
    full = (1 << len(b)) - 1
    row, rows = full, [full]
    for token in a:
        hit = row & where.get(token, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    return rows


def positions(a: list, b: list) -> list[int]:
    """Positions in ``a`` of one longest common subsequence with ``b``."""
    rows = bit_rows(a, b)
    i, j, found = len(a), len(b), []
    while i and j:
        if a[i - 1] == b[j - 1]:
            found.append(i - 1)
            i, j = i - 1, j - 1
        elif (rows[i] & ((1 << j) - 1)).bit_count() < (rows[i - 1] & ((1 << j) - 1)).bit_count():
            j -= 1
        else:
            i -= 1
    return found[::-1]


def split(tokens: np.ndarray, rows: np.ndarray, border: int) -> tuple[Texts, Texts, np.ndarray]:
    """Whole texts, their sentences and each sentence's row, of tokens with ``border`` between sentences; ``rows`` are
    the borders of rows."""
    row = np.repeat(np.arange(len(rows) - 1), np.diff(rows))
    word = tokens != border
    sentence = np.cumsum(~word) + row  # a new number at each border and each row
    kept, row, sentence = tokens[word], row[word], sentence[word]
    sizes = np.bincount(row, minlength=len(rows) - 1)
    whole = Texts(kept, np.cumsum(sizes) - sizes, sizes)
    starts = np.flatnonzero(np.diff(sentence, prepend=-1))
    ends = np.append(starts[1:], len(kept))
    return whole, Texts(kept, starts, ends - starts), row[starts]


def hits(ref: tuple[np.ndarray, np.ndarray], pred: tuple[np.ndarray, np.ndarray], border: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: common length of the whole texts, and matched tokens of the summary form (the union, for each sentence of
    the reference, of its subsequences with all sentences of the prediction; no token more often than the prediction has it)."""
    (a, a_part, a_row), (b, b_part, b_row) = split(*ref, border), split(*pred, border)
    n = len(a.sizes)
    each = np.arange(n)
    long = lengths(a, b, each, each)
    others = np.bincount(b_row, minlength=n)
    begin = np.cumsum(others) - others
    left = np.repeat(np.arange(len(a_row)), others[a_row])
    many = others[a_row]
    right = np.arange(len(left)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(begin[a_row], many)
    mark = matched(a_part, b_part, left, right)
    kinds = int(max(a.tokens.max(initial=0), b.tokens.max(initial=0))) + 1
    found, times = np.unique((np.repeat(each, a.sizes) * kinds + a.tokens)[mark], return_counts=True)
    there, most = np.unique(np.repeat(each, b.sizes) * kinds + b.tokens, return_counts=True)
    at = np.minimum(np.searchsorted(there, found), max(len(there) - 1, 0))
    limit = np.where(there[at] == found, most[at], 0) if len(there) else np.zeros(len(found), np.int64)
    return long, np.bincount(found // kinds, np.minimum(times, limit), n).astype(np.int64)
