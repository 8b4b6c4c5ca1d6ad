"""Best-fit packing of tokenised documents by exact-complement hashing.

Documents are tokenised where they lie; only (doc_id, piece, start, length, checksum) rows move. Packing needs no more
than how many pieces there are of each length (at most ``LIMIT`` numbers): the driver plans on that histogram, in
patterns "these lengths, so many times", and the pieces find their place by (length, rank within the length).

Planning: long pieces (over an eighth of a sequence) are placed best-fit, longest first. Each gap that they leave is looked
up in the index of single lengths, of pair sums and of triple sums, and combinations that fill it exactly are taken as often
as their counts allow. What has no exact filling is placed best-fit.

Nulls and odd input: a null or empty text is one piece with the end token alone; a null doc_id is kept and sorts first.
Repeated rows are packed as often as they occur. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inferlytics.llm.common import settle, table

LIMIT = 4096
END_TOKEN = 1
SALTS = 256  # a length is ranked in so many parts, so that a frequent length is not one task
TOKENIZER = "word_bpe_49k.json"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row_hash long"
CACHE_WORDS = 400_000


class WordEncoder:
    """Token ids of a text, looked up word by word.

    The tokenizer never merges across white space or between a letter and punctuation, lower-cases, and takes a word of
    letters as it is; so a text's ids are those of its words, and a word's are those of its core and of the punctuation
    around it. The ids of all words lie in one array; a dictionary has their numbers. Beyond ``capacity`` words it starts
    anew, so memory is bounded.
    """

    SEPARATOR = "|"
    PUNCTUATION = '!"#$%&()*+,-./:;<=>?@[\\]^_`{|}~'  # without the apostrophe, which contractions need
    CORE = "^[a-z0-9](?s:.*)[a-z0-9]$|^[a-z0-9]$"

    def __init__(self, path: str, capacity: int = CACHE_WORDS):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.tokenizer.model)  # one vocabulary; a word of a to z needs no normalising or cutting
        self.letters.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.separator = self.tokenizer.encode(self.SEPARATOR, add_special_tokens=False).ids
        self.capacity = capacity
        self.clear()

    def clear(self) -> None:
        self.numbers = {"": 0}
        self.ids, self.ends = np.zeros(0, np.uint32), np.zeros(2, np.int32)

    def _add(self, words: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.ends) - 1
        self.numbers.update(zip(words, range(first, first + len(words)), strict=True))
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes, dtype=np.int32)])
        self.ids = np.concatenate([self.ids, ids])

    def _lists(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words of these numbers, one after another, and where each ends."""
        found = pa.ListArray.from_arrays(pa.array(self.ends), pa.array(self.ids)).take(pa.array(numbers))
        return found.flatten().to_numpy(), found.offsets.to_numpy()

    def _tokenize(self, tokenizer, items: list[str]) -> None:
        """Learn items without the separator, many in one text."""
        texts = [f" {self.SEPARATOR} ".join([*items[at : at + 1000], ""]) for at in range(0, len(items), 1000)]
        coded = tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        ids = np.concatenate([np.zeros(0, np.uint32), *[np.array(e.ids, np.uint32) for e in coded]])
        cuts = np.flatnonzero(ids == self.separator[0])
        self._add(items, np.delete(ids, cuts), np.diff(cuts, prepend=-1) - 1)

    def learn(self, unknown: np.ndarray) -> None:
        words = pa.array(unknown, pa.string())
        core = pc.ascii_trim(words, self.PUNCTUATION)
        cut = pc.and_(pc.match_substring_regex(core, self.CORE), pc.not_equal(core, words))
        cut = pc.and_not(cut, pc.match_substring(words, "<|"))
        edged = unknown[cut.to_numpy(zero_copy_only=False)].tolist()
        parts = list(chain.from_iterable(map(str.partition, edged, core.filter(cut).to_pylist())))  # before, core, after
        whole = dict.fromkeys(chain(unknown[pc.invert(cut).to_numpy(zero_copy_only=False)].tolist(), parts))
        new = np.array([w for w in whole if w not in self.numbers], object)
        coded = pa.array(new, pa.string())
        letters = pc.match_substring_regex(coded, "^[a-z]+$").to_numpy(zero_copy_only=False)
        split = pc.match_substring(coded, self.SEPARATOR).to_numpy(zero_copy_only=False)
        self._tokenize(self.letters, new[letters].tolist())
        self._tokenize(self.tokenizer, new[~(letters | split)].tolist())
        for word in new[split].tolist():
            ids = np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, np.uint32)
            self._add([word], ids, np.array([len(ids)]))
        ids, ends = self._lists(np.fromiter(map(self.numbers.__getitem__, parts), np.int32, len(parts)))
        self._add(edged, ids, np.diff(ends[::3]))

    def recall(self, words: pa.Array) -> np.ndarray:
        """Numbers of distinct words."""
        if len(self.numbers) > self.capacity:
            self.clear()
        names = words.to_numpy(zero_copy_only=False)
        found = np.fromiter(map(self.numbers.get, names, repeat(-1)), np.int32, len(names))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            self.learn(names[missing])
            found[missing] = list(map(self.numbers.__getitem__, names[missing]))
        return found

    def encode(self, texts: pa.Array, together: int = 2000) -> Iterator[bytes]:
        end = np.array([END_TOKEN], "<u4").tobytes()
        for at in range(0, len(texts), together):
            part = texts.slice(at, together)
            # special tokens are told from like texts by their case
            part = pc.if_else(pc.match_substring(part, "<|"), part, pc.ascii_lower(part))
            words = pc.ascii_split_whitespace(part)
            coded = words.flatten().dictionary_encode()
            known = self.recall(coded.dictionary)
            ids, reached = self._lists(known[coded.indices.to_numpy(zero_copy_only=False)])
            cuts = reached[words.offsets.to_numpy() - words.offsets[0].as_py()].tolist()
            ids = ids.astype("<u4", copy=False)
            for a, b in zip(cuts, cuts[1:], strict=False):
                yield ids[a:b].tobytes() + end


_ENCODERS: dict[str, WordEncoder] = {}


def _pieces(path: str | None, limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers

        place = path or public_tokenizers.path(TOKENIZER)
        encoder = _ENCODERS.setdefault(place, WordEncoder(place))
        for batch in batches:
            rows: list[tuple] = []
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for doc_id, hash_, packed in zip(ids, hashes, encoder.encode(batch.column(2)), strict=True):
                for piece, at in enumerate(range(0, len(packed), 4 * limit)):
                    part = packed[at : at + 4 * limit]
                    rows.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part), hash_))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            columns = [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in PIECES.split(", ")])

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """Pieces of at most ``limit`` tokens; ``tokenizer`` is a file path, by default that of the public tokenizer."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", text).alias("row_hash"), text.alias("text"))
    return rows.mapInArrow(_pieces(tokenizer, limit), PIECES)


class _Sums:
    """Index of the lengths at hand as bits of whole numbers: which sums have a single, a pair or a triple of them."""

    def __init__(self, counts: list[int], limit: int):
        self.counts, self.limit = counts, limit
        self.up = sum(1 << x for x, n in enumerate(counts) if n)  # bit x: length x is there
        self.down = sum(1 << (limit - x) for x, n in enumerate(counts) if n)

    def take(self, lengths: tuple[int, ...], most: int) -> int:
        """Use these lengths together as often as their counts allow, up to ``most`` times; how often."""
        n = min(most, *[self.counts[x] // lengths.count(x) for x in lengths])
        for x in lengths if n else ():
            self.counts[x] -= n
        for x in set(lengths):
            if not self.counts[x]:
                self.up &= ~(1 << x)
                self.down &= ~(1 << (self.limit - x))
        return n

    def singles(self, gap: int) -> Iterator[tuple[int, ...]]:
        if self.up >> gap & 1:
            yield (gap,)

    def pairs(self, gap: int, most: int | None = None) -> Iterator[tuple[int, ...]]:
        """Pairs of sum ``gap``, the longer member first and up to ``most``, the longest first."""
        high = min(gap - 1, gap if most is None else most)
        allowed = (1 << (high + 1)) - (1 << (gap + 1) // 2) if high >= (gap + 1) // 2 else 0
        while longer := max((self.up & (self.down >> (self.limit - gap)) & allowed).bit_length() - 1, 0):
            yield longer, gap - longer
            allowed &= (1 << longer) - 1

    def triples(self, gap: int) -> Iterator[tuple[int, ...]]:
        longest = self.up & ((1 << max(gap - 1, 0)) - 1)
        while (one := longest.bit_length() - 1) * 3 >= gap > 2:
            for pair in self.pairs(gap - one, one):
                yield one, *pair
            longest &= (1 << one) - 1


class _Sequences:
    """Sequences by their free room; equal ones are handled together."""

    def __init__(self, limit: int):
        self.limit = limit
        self.rooms: list[int] = []  # sorted
        self.groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(self, room: int, pattern: tuple[int, ...], n: int) -> None:
        if room not in self.groups:
            self.groups[room] = []
            insort(self.rooms, room)
        self.groups[room].append((pattern, n))

    def pop(self, room: int) -> tuple[tuple[int, ...], int]:
        group = self.groups[room].pop()
        if not self.groups[room]:
            del self.groups[room], self.rooms[bisect_left(self.rooms, room)]
        return group

    def best_fit(self, counts: list[int], longest: int, shortest: int) -> None:
        """Place these lengths, longest first, each where least room is left; uses up the counts."""
        for length in range(longest, shortest - 1, -1):
            left, counts[length] = counts[length], 0
            while left:
                at = bisect_left(self.rooms, length)
                if at == len(self.rooms):
                    per = self.limit // length
                    for fill in (per, left % per) if left >= per else (left,):
                        if fill:
                            n = left // per if fill == per else 1
                            self.put(self.limit - fill * length, (length,) * fill, n)
                            left -= n * fill
                    continue
                room = self.rooms[at]
                pattern, n = self.pop(room)
                used = min(n, left)
                if used < n:
                    self.put(room, pattern, n - used)
                self.put(room - length, (*pattern, length), used)
                left -= used

    def fill_exactly(self, sums: _Sums) -> None:
        """Fill gaps, large ones first: all that can be by one length, then by two, then by three."""
        for fillings in (sums.singles, sums.pairs, sums.triples):
            for room in [r for r in reversed(self.rooms) if r]:
                for pattern, n in [self.pop(room) for _ in range(len(self.groups[room]))]:
                    for rest in fillings(room) if n else ():
                        if done := sums.take(rest, n):
                            self.put(0, (*pattern, *rest), done)
                            n -= done
                        if not n:
                            break
                    if n:
                        self.put(room, pattern, n)


def plan(histogram: dict[int, int], limit: int = LIMIT, small: int | None = None) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths, times) that use up the histogram.

    Pieces over ``small`` (by default an eighth of the limit) are placed best-fit and leave gaps; shorter ones fill gaps
    exactly, as far as their counts allow, and the rest is placed best-fit. Exact filling with longer pieces would spend
    what a medium piece can use in no other place.
    """
    small = limit // 8 if small is None else small
    counts = [0] * (limit + 1)
    for length, n in histogram.items():
        counts[length] = n
    sequences = _Sequences(limit)
    sequences.best_fit(counts, limit, small + 1)
    sequences.fill_exactly(_Sums(counts, limit))
    sequences.best_fit(counts, small, 1)
    return [group for groups in sequences.groups.values() for group in groups]


def places(patterns: list[tuple[tuple[int, ...], int]]) -> pd.DataFrame:
    """(length, rank, sequence_id, offset) of the first of each run of equal slots; within a run rank and id count up."""
    used: dict[int, int] = {}
    rows, sequence = [], 0
    for lengths, n in patterns:
        offset = 0
        for length in lengths:
            rank = used.get(length, 0)
            rows.append((length, rank, sequence, offset))
            used[length] = rank + n
            offset += length
        sequence += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence_id", "offset"]).sort_values(["length", "rank"])


def _place(found):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = found.value
        ranks = {length: part for length, part in slots.groupby("length")}
        for batch in batches:
            frame = batch.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)
            sequence, offset = np.zeros(len(frame), np.int64), np.zeros(len(frame), np.int64)
            lengths, rank = frame["length"].to_numpy(np.int64), frame["rank"].to_numpy(np.int64)
            for length in np.unique(lengths):
                part, mine = ranks[length], lengths == length
                at = np.searchsorted(part["rank"].to_numpy(), rank[mine], "right") - 1
                sequence[mine] = part["sequence_id"].to_numpy()[at] + rank[mine] - part["rank"].to_numpy()[at]
                offset[mine] = part["offset"].to_numpy()[at]
            names = batch.schema.names[:5]
            columns = [batch.column(i) for i in range(5)] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece."""
    spark = docs.sparkSession
    cut = settle(pieces(docs, tokenizer, limit).withColumn("salt", F.pmod("row_hash", F.lit(SALTS))), "pieces")
    parts = cut.groupBy("length", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    parts = settle(parts.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))), "parts")
    histogram = {r["length"]: r["n"] for r in parts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    slots = spark.sparkContext.broadcast(places(plan(histogram, limit)))
    order = Window.partitionBy("length", "salt").orderBy("row_hash", "doc_id", "piece")
    ranked = cut.withColumn("local", F.row_number().over(order)).join(parts, ["length", "salt"])
    rows = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("local") - 1).alias("rank"))
    kept = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return rows.mapInArrow(_place(slots), kept)


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of the documents."""
    return pack(docs)


def query(spark, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
