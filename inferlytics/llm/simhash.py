"""SimHash near-duplicates by multi-index hashing.

A 64-bit fingerprint is cut into segments. Two fingerprints within ``DISTANCE`` bits agree in at least one segment up to
that segment's radius (the radii plus one add up to ``DISTANCE`` + 1), so each fingerprint enters a table under each
segment value and asks at every value of a small Hamming ball around it. What meets at a table key is compared on all 64
bits. A key with many fingerprints answers with a spanning forest of its links, never with all its pairs; a key with
more than ``HOT`` table entries is cut into pairs of chunks that are spread over the cluster.

Equal fingerprints are one vertex, so copies cost nothing but their row. A null text counts as empty; texts without words
have the fingerprint zero and link like any other. Ids: the component's id is its smallest non-null doc_id (null if it
has none); repeated rows are returned as often as they occur. Empty tables give empty results; extra columns are ignored.

The pipeline's stage has another rule: texts are near copies when the sets of their runs of five words have a Jaccard
similarity of ``NEAR`` or more. Minhash bands propose first: texts that share a band, and chains of them, form a group. In
a group all pairs are compared by their whole sets. Bands may miss a pair (at 0.8 one of a thousand), so a second search,
between the components found, misses none: runs are put in one order, rare ones first, and two near copies must share a
run among the first fifth of both. Size, place in the order and a parity bitmap, which only ever rule out pairs below
``NEAR``, thin these pairs out; whole sets decide. The counts behind the order steer the work, never the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferlytics.llm.common import BROADCAST_KEYS, DOCUMENTS, beside_texts, only, settle, table, text_key

DISTANCE = 4
SEGMENTS = 3  # widths near log2 of the number of fingerprints give the fewest false meetings
WORDS = 4
SEED = 42
HOT = 4096
FEW = 16  # keys with at most so many comparisons are compared all at once
STAGE_WORDS = 5
NEAR = (4, 5)  # similarity from which texts are near copies, as a fraction
BANDS, BAND = 30, 7  # 1 - (1 - 0.8 ** 7) ** 30 = 0.9991
CHUNK = 256  # texts of a group that go together; two chunks are compared in one task
CHUNK_RUNS = 1 << 20  # and about so many runs of words
PARTS = 10  # bits of a run's hash that name the part in which it is counted; 32 more tell runs of a part apart
LISTED = 64  # most frequent runs of a part that are known by their counts
SLOTS = 14  # bits of a place in a part's table of runs that occur twice
CROWD = 1024  # texts of one frequent run that go together; two such chunks are compared in one task
PAIRS = 1 << 18  # pairs looked at in one piece
SLICE = 256  # texts worked on at a time


def _shingles(text: str | None, words: int) -> Iterator[np.ndarray]:
    """Hashes of all word shingles, in blocks; nothing for a text without words."""
    import xxhash

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    if len(found) > words:
        starts, ends = starts[: 1 - words], ends[words - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)].tolist(), ends[at : at + (1 << 16)].tolist(), strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in part], "<u8")


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Majority bits over the hashes of all word shingles, as an unsigned integer."""
    ones, count = np.zeros(64, np.int64), 0
    for hashes in _shingles(text, words):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        count += len(hashes)
    bits = (2 * ones > count).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        values = np.array([fingerprint(t) for t in batch.column(2).to_pylist()], np.uint64).view(np.int64)
        columns = [batch.column(0), batch.column(1), pa.array(values)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fp) of every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    return rows.mapInArrow(_fingerprints, "doc_id long, text_key long, fp long")


def segments(count: int = SEGMENTS, distance: int = DISTANCE) -> list[tuple[int, int, int]]:
    """(offset, width, radius) per segment; a negative radius leaves the segment out."""
    cuts = [64 * k // count for k in range(count + 1)]
    units = [(distance + 1) // count + (k < (distance + 1) % count) for k in range(count)]
    return [(a, b - a, u - 1) for a, b, u in zip(cuts, cuts[1:], units, strict=False)]


def _ball(width: int, radius: int) -> list[int]:
    return [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]


def _ask_around(value: Column, ball: list[int], segment: int, count: int) -> Column:
    """Structs (key, home) for all values of a ball around a segment's value."""
    masks = F.array(*[F.lit(m).cast("long") for m in ball])

    def place(mask: Column, i: Column) -> Column:
        return F.struct((value.bitwiseXOR(mask) * count + segment).alias("key"), (i == 0).alias("home"))

    return F.transform(masks, place)


def lookups(points: DataFrame, count: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """(key, fp, home): where each fingerprint is stored (home) and where it asks."""
    rows = []
    for k, (offset, width, radius) in enumerate(segments(count, distance)):
        if radius < 0:
            continue
        value = F.shiftrightunsigned("fp", offset).bitwiseAND(F.lit((1 << width) - 1))
        rows.append(_ask_around(value, _ball(width, radius), k, count))
    return points.select("fp", F.explode(F.concat(*rows)).alias("at")).select("at.key", "fp", "at.home")


def _forest(fps: np.ndarray, homes: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Spanning star edges of the links between the first ``homes`` fingerprints and all of them."""
    label = np.arange(len(fps))
    for i in range(homes):
        near = label[np.bitwise_count(fps ^ fps[i]) <= distance]
        low, high = near.min(), near.max()
        if low != high:
            label[np.isin(label, near)] = low
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _solve(key: np.ndarray, fps: np.ndarray, home: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of complete keys; rows are sorted by key, homes first."""
    begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
    size = np.diff(np.append(begin, len(key)))
    homes = np.add.reduceat(home.astype(np.int64), begin) if len(key) else size
    live = (size > 1) & (homes > 0)
    begin, size, homes = begin[live], size[live], homes[live]
    few = size * homes <= FEW
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    b, s, h = begin[few], size[few], homes[few]
    pairs = s * h
    group = np.repeat(np.arange(len(b)), pairs)
    within = np.arange(len(group)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
    left, right = b[group] + within // s[group], b[group] + within % s[group]
    later = right > left
    left, right = fps[left[later]], fps[right[later]]
    close = np.bitwise_count(left ^ right) <= distance
    ends.append((left[close], right[close]))
    for at, n, m in zip(begin[~few].tolist(), size[~few].tolist(), homes[~few].tolist(), strict=True):
        ends.append(_forest(fps[at : at + n], m, distance))
    return np.concatenate([x for x, _ in ends]), np.concatenate([y for _, y in ends])


def _meet(distance: int, hot: int):
    """Edges (kind 0: a, b) of sorted (key, fp, home) rows; rows of keys over ``hot`` homes pass through (kind 1)."""

    def out(kind: int, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        columns = [pa.array(np.full(len(a), kind, np.int32)), pa.array(key), pa.array(a.view(np.int64)), pa.array(b)]
        return pa.RecordBatch.from_arrays(columns, ["kind", "key", "a", "b"])

    def solved(key: np.ndarray, fps: np.ndarray, home: np.ndarray) -> Iterator[pa.RecordBatch]:
        a, b = _solve(key, fps, home, distance)
        if len(a):
            yield out(0, np.zeros(len(a), np.int64), a, b.view(np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fps, home = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, bool)
        passing = None
        for batch in batches:
            new = batch.column(0).to_numpy()
            f, h = batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False)
            if passing is not None:
                same = int(np.searchsorted(new, passing, "right"))
                if same:
                    yield out(1, new[:same], f[:same], h[:same].astype(np.int64))
                    new, f, h = new[same:], f[same:], h[same:]
                if not len(new):
                    continue
                passing = None
            key, fps, home = np.concatenate([key, new]), np.concatenate([fps, f]), np.concatenate([home, h])
            last = int(np.searchsorted(key, key[-1]))
            yield from solved(key[:last], fps[:last], home[:last])
            key, fps, home = key[last:], fps[last:], home[last:]
            if home.sum() > hot:
                yield out(1, key, fps, home.astype(np.int64))
                passing = key[0]
                key, fps, home = key[:0], fps[:0], home[:0]
        yield from solved(key, fps, home)

    return run


MET = "kind int, key long, a long, b long"


def links(points: DataFrame, count: int = SEGMENTS, distance: int = DISTANCE, hot: int = HOT) -> DataFrame:
    """(a, b): edges that connect exactly the fingerprints that chains of links connect."""
    rows = lookups(points, count, distance)
    sort = ("key", F.col("home").desc())
    met = settle(rows.repartition("key").sortWithinPartitions(*sort).mapInArrow(_meet(distance, hot), MET), "met")
    edges = met.where("kind = 0").select("a", "b")
    large = met.where("kind = 1").select("key", F.col("a").alias("fp"), (F.col("b") == 1).alias("home"))
    chunks = large.groupBy("key").agg(F.ceil(F.sum(F.col("home").cast("long")) / hot).cast("int").alias("n"))
    dealt = large.join(chunks, "key").withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n")).cast("int"))
    others = F.sequence(F.lit(0), F.col("n") - 1)
    pairs = F.when(
        F.col("home"),
        F.concat(
            F.transform(others, lambda j: F.struct(F.col("own").alias("i"), j.alias("j"), F.lit(True).alias("home"))),
            F.transform(
                F.filter(others, lambda i: i != F.col("own")),
                lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("home")),
            ),
        ),
    ).otherwise(F.transform(others, lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("home"))))
    spread = dealt.select("key", "fp", F.explode(pairs).alias("at"))
    cells = spread.select(F.xxhash64("key", "at.i", "at.j").alias("key"), "fp", F.col("at.home").alias("home"))
    more = cells.repartition("key").sortWithinPartitions(*sort).mapInArrow(_meet(distance, 1 << 40), MET)
    return settle(edges.union(more.select("a", "b")).distinct(), "links")


def components(edges: DataFrame) -> DataFrame:
    """(v, root): smallest vertex that each vertex of ``edges`` reaches, by alternating large and small stars.

    The number of rounds grows with the logarithm of the longest chain; each round's edges are a written table.
    """
    edges = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if before == now or not now["n"]:
            return edges.select(F.col("a").alias("v"), F.col("b").alias("root"))
        before = now
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).distinct()
        large = settle(large, "large")
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = settle(moved.union(low.select("a", F.col("m").alias("b"))).distinct(), "small")


def near_duplicates(docs: DataFrame, count: int = SEGMENTS, distance: int = DISTANCE) -> DataFrame:
    """doc_id, text_key, fingerprint (16 hex digits), component_id of every row."""
    rows = settle(fingerprints(docs), "fingerprints")
    points = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "points")
    roots = components(links(points.select("fp"), count, distance))
    placed = points.join(roots, points["fp"] == roots["v"], "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    placed = settle(placed, "placed")
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_point = placed.select("fp", "root").join(named, "root").select("fp", "component_id")
    return rows.join(by_point, "fp").select(
        "doc_id", "text_key", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def runs_of(text: str | None, words: int = STAGE_WORDS) -> np.ndarray:
    """Sorted distinct hashes of a text's runs of words."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *_shingles(text, words)]))


def bands(runs: np.ndarray) -> list[int]:
    """A key for each band of minhashes; texts are compared when they share one. None for a text without words."""
    import xxhash

    if not len(runs):
        return []
    rng = np.random.default_rng(SEED)
    factor, shift = rng.integers(0, 1 << 63, (2, BANDS * BAND, 1), np.uint64)
    factor, low = 2 * factor + 1, np.full(BANDS * BAND, ~np.uint64(0))
    for at in range(0, len(runs), 512):
        low = np.minimum(low, (factor * runs[at : at + 512] + 2 * shift).min(1))
    rows = low.reshape(BANDS, BAND)
    return np.array([xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)], np.uint64).view(np.int64).tolist()


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few texts, so that little is held beside the texts of a task."""
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            yield batch.slice(at, SLICE)


def _split_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(part, runs): the runs of texts by part, 32 bits each, about ``CHUNK_RUNS`` / 4 of them at a time."""

    def split(sets: list[np.ndarray]) -> pa.RecordBatch:
        codes = np.concatenate(sets) >> (32 - PARTS)
        codes.sort()
        cuts = np.searchsorted(codes, np.arange(1 << PARTS, dtype="<u8") << 32)
        cuts = np.append(cuts, len(codes))
        held = np.flatnonzero(np.diff(cuts))
        low = codes.astype("<u4")
        columns = [pa.array(held.astype(np.int32)), pa.array([low[cuts[k] : cuts[k + 1]].tobytes() for k in held], pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "runs"])

    sets, count = [], 0
    for batch in _slices(batches):
        for text in batch.column(0).to_pylist():
            sets.append(runs_of(text))
            count += len(sets[-1])
            if 4 * count >= CHUNK_RUNS:
                yield split(sets)
                sets, count = [], 0
    if count:
        yield split(sets)


def _repeated(group: pa.Table) -> pa.Table:
    """The most frequent runs of a part with their counts, and the table of the runs that occur twice or more."""
    low = np.frombuffer(b"".join(group.column("runs").to_pylist()), "<u4")
    runs, counts = np.unique(low, return_counts=True)
    runs, counts = runs[counts > 1], counts[counts > 1]
    slots = np.zeros(1 << SLOTS, np.uint8)
    slots[runs >> (32 - SLOTS)] = 1
    top = np.sort(np.lexsort((runs, -counts))[:LISTED])
    out = {"runs": runs[top], "counts": counts[top].astype("<i8"), "slots": np.packbits(slots, bitorder="little")}
    return pa.table({"part": group.column("part")[:1], **{k: pa.array([x.tobytes()], pa.binary()) for k, x in out.items()}})


class Frequencies:
    """What is known of how often runs occur: some 3 MB, whatever the number of texts."""

    def __init__(self, parts: list) -> None:
        parts = sorted(parts, key=lambda r: r["part"])
        codes = [(np.uint64(r["part"]) << np.uint64(32)) + np.frombuffer(r["runs"], "<u4").astype("<u8") for r in parts]
        self.codes = np.concatenate([np.zeros(0, "<u8"), *codes])
        self.counts = np.concatenate([np.zeros(0, "<i8"), *[np.frombuffer(r["counts"], "<i8") for r in parts]])
        self.slots = np.zeros((1 << PARTS, (1 << SLOTS) // 8), np.uint8)
        for r in parts:
            self.slots[r["part"]] = np.frombuffer(r["slots"], np.uint8)

    def of(self, runs: np.ndarray) -> np.ndarray:
        """0 for runs that occur once, the count of listed ones, 1 for the others."""
        codes = runs >> np.uint64(32 - PARTS)
        slot = (codes & np.uint64((1 << 32) - 1)) >> np.uint64(32 - SLOTS)
        many = (self.slots[codes >> np.uint64(32), slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(np.int64)
        again = np.flatnonzero(many)
        at = np.searchsorted(self.codes, codes[again])
        listed = at < len(self.codes)
        listed[listed] = self.codes[at[listed]] == codes[again][listed]
        many[again[listed]] = self.counts[at[listed]]
        return many


def frequencies(docs: DataFrame) -> Frequencies:
    """Frequencies of the runs of all texts."""
    runs = docs.select("text").mapInArrow(_split_runs, "part int, runs binary")
    return Frequencies(runs.groupBy("part").applyInArrow(_repeated, "part int, runs binary, counts binary, slots binary").collect())


def prefix(runs: np.ndarray, known: Frequencies) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs, their places and counts: the first of a set in the order of (count, hash), without those that no other set has.

    A near copy shares at least four fifths of the runs, so it cannot lack all of the first fifth and one more.
    """
    part, whole = NEAR
    many = known.of(runs)
    first = np.lexsort((runs, many))[: len(runs) - -(-part * len(runs) // whole) + 1]
    places = np.flatnonzero(many[first])
    return runs[first[places]], places, many[first[places]]


def parity(runs: np.ndarray) -> bytes:
    """A bitmap of at least as many bits as runs; of two sets it differs in no more bits than the sets in runs."""
    width = max(64, 1 << (len(runs) - 1).bit_length()) if len(runs) else 64
    ones = np.bincount((runs & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1
    return np.packbits(ones.astype(np.uint8), bitorder="little").tobytes()


def _differing(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded."""
    x, y = sorted((np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")), key=len)
    return int(np.bitwise_count(x ^ np.bitwise_xor.reduce(y.reshape(-1, len(x)), axis=0)).sum())


SKETCH = "doc_id long, text_key long, v long, size long, keys array<long>, bits binary, at array<struct<run:long,place:long,chunks:long>>"


def _sketches(known: Frequencies):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in _slices(batches):
            names, sizes, keys, bits, firsts = [], [], [], [], []
            for text in batch.column(2).to_pylist():
                runs = runs_of(text)
                names.append(xxhash.xxh64_intdigest(runs.tobytes(), SEED))
                sizes.append(len(runs))
                keys.append(bands(runs))
                bits.append(parity(runs))
                firsts.append(prefix(runs, known))
            found, places, counts = (np.concatenate([np.zeros(0, np.int64), *[x[k].astype(np.int64) for x in firsts]]) for k in range(3))
            at = pa.StructArray.from_arrays([pa.array(x) for x in (found, places, -(-counts // CROWD))], ["run", "place", "chunks"])
            offsets = np.cumsum([0, *[len(x[0]) for x in firsts]]).astype(np.int32)
            columns = [
                pa.array(np.array(names, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())),
                pa.array(bits, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), at),
            ]
            columns = [batch.column(0), batch.column(1), *columns]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_key", "v", "size", "keys", "bits", "at"])

    return run


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges from each vertex to the first of its key; rows are sorted by key."""
    key, first = None, 0
    for batch in batches:
        keys, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(keys):
            continue
        begin = np.concatenate([[keys[0] != key], keys[1:] != keys[:-1]])
        at = np.maximum.accumulate(np.where(begin, np.arange(len(keys)), -1))
        head = np.where(at < 0, first, v[at])
        far = head != v
        key, first = keys[-1], head[-1]
        yield pa.RecordBatch.from_arrays([pa.array(v[far]), pa.array(head[far])], ["a", "b"])


def near_links(sets: list[np.ndarray]) -> np.ndarray:
    """Smallest index that each set reaches by chains of pairs of similarity ``NEAR`` or more; all pairs count."""
    part, whole = NEAR
    n, label = len(sets), np.arange(len(sets))
    sizes = np.array([len(x) for x in sets], np.int64)
    owner = np.repeat(np.arange(n, dtype=np.int32), sizes)
    runs = np.concatenate([np.zeros(0, np.uint64), *sets])
    order = np.argsort(runs, kind="stable")
    owner, runs = owner[order], runs[order]
    new = np.concatenate([[True], runs[1:] != runs[:-1]]) if len(runs) else np.zeros(0, bool)
    begin = np.flatnonzero(new)[np.cumsum(new) - 1]  # where the run's owners begin; those before an entry come earlier
    before = np.arange(len(runs)) - begin
    shared = np.flatnonzero(before)
    shared = shared[np.argsort(owner[shared], kind="stable")]
    cuts = np.searchsorted(owner[shared], np.arange(n + 1))
    step = max(1, (1 << 20) // max(n, 1))
    for i in range(n):
        common = np.zeros(i, np.int64)
        for at in range(cuts[i], cuts[i + 1], step):
            e = shared[at : min(at + step, cuts[i + 1])]
            many = before[e]
            places = np.repeat(begin[e] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            common += np.bincount(owner[places], minlength=i)
        near = label[:i][(whole + part) * common >= part * (sizes[:i] + sizes[i])]
        if len(near):
            label[i] = near.min()
            label[: i + 1][np.isin(label[: i + 1], near)] = near.min()
    return label


def _compared(group: pa.Table) -> pa.Table:
    v = group.column("v").to_numpy()
    label = near_links([runs_of(t) for t in group.column("text").to_pylist()])
    moved = np.flatnonzero(label != np.arange(len(v)))
    return pa.table({"a": v[moved], "b": v[label[moved]]})


def _crossing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of different roots that share a cell and may be near copies; rows are sorted by cell and root."""
    part, whole = NEAR

    def pairs(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        cell, root, v, size, place = rows
        after = np.searchsorted(cell, cell, "right")
        new = np.concatenate([[True], (cell[1:] != cell[:-1]) | (root[1:] != root[:-1])])
        begin = np.append(np.flatnonzero(new), len(cell))
        begin = begin[np.cumsum(new)]  # of the next root
        many = after - begin
        total = np.cumsum(many)
        for low in range(0, int(total[-1]), PAIRS):
            k = np.arange(low, min(low + PAIRS, int(total[-1])))
            i = np.searchsorted(total, k, "right")
            j = begin[i] + k - (total[i] - many[i])
            most = np.minimum(size[i] - place[i], size[j] - place[j])  # runs in common, if this is the first of them
            near = (whole + part) * most >= part * (size[i] + size[j])
            i, j = v[i[near]], v[j[near]]
            ends = np.unique(np.stack([np.minimum(i, j), np.maximum(i, j)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(ends[0]), pa.array(ends[1])], ["a", "b"])

    held: list[np.ndarray] = []
    for batch in batches:
        rows = np.stack([c.to_numpy() for c in batch.columns])
        last = int(np.searchsorted(rows[0], rows[0, -1])) if rows.size else 0
        if last:
            yield from pairs(np.concatenate([*held, rows[:, :last]], axis=1))
            held = [rows[:, last:]]
        elif rows.size and held and held[0][0, 0] != rows[0, 0]:
            yield from pairs(np.concatenate(held, axis=1))
            held = [rows]
        else:
            held.append(rows)
    if held and held[0].size:
        yield from pairs(np.concatenate(held, axis=1))


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose bitmaps leave a similarity of ``NEAR`` possible."""
    part, whole = NEAR
    for batch in batches:
        a, b, total, x, y = batch.columns
        differ = np.array([_differing(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], np.int64)
        near = pa.array((whole + part) * differ <= (whole - part) * total.to_numpy())
        yield pa.RecordBatch.from_arrays([a.filter(near), b.filter(near)], ["a", "b"])


def _cells(group: Column, own: Column, n: Column) -> Column:
    """One cell for a group of one chunk, else those of a chunk with each of the others."""
    others = F.filter(F.sequence(F.lit(0).cast("long"), n - 1), lambda k: k != own)
    pairs = F.transform(others, lambda k: F.xxhash64(group, F.least(own, k), F.greatest(own, k)))
    return F.when(n == 1, F.array(F.xxhash64(group))).otherwise(pairs)


def _linked(rows: DataFrame, wanted: DataFrame, cells: Column, name: str) -> DataFrame:
    """(a, b): edges that connect the near copies among the texts ``wanted`` (v, key and what ``cells`` needs) of a cell."""
    wanted = wanted.withColumns({"_id": F.col("key.doc_id"), "_hash": F.col("key.text_key")}).drop("key")
    wanted = beside_texts(wanted, name, BROADCAST_KEYS // 2)
    found = rows.join(wanted, (F.col("text_key") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")))
    return found.select(F.explode(cells).alias("cell"), "v", "text").groupBy("cell").applyInArrow(_compared, "a long, b long")


def missed(rows: DataFrame, points: DataFrame) -> DataFrame:
    """(a, b): near copies of different roots among ``points`` (v, key, root, size, bits, at), all that there are."""
    entries = points.select("v", "root", "size", F.explode("at").alias("at")).select("v", "root", "size", "at.*")
    own = F.pmod(F.xxhash64("v"), F.col("chunks"))
    cells = entries.select(F.explode(_cells(F.col("run"), own, F.col("chunks"))).alias("cell"), "root", "v", "size", "place")
    pairs = cells.repartition("cell").sortWithinPartitions("cell", "root").mapInArrow(_crossing, "a long, b long").distinct()
    for end in ("a", "b"):
        side = points.select(F.col("v").alias(end), F.col("size").alias(f"size_{end}"), F.col("bits").alias(f"bits_{end}"))
        pairs = pairs.join(side, end)
    pairs = pairs.select("a", "b", F.col("size_a") + F.col("size_b"), "bits_a", "bits_b").mapInArrow(_possible, "a long, b long")
    pairs = settle(pairs, "possible")
    ends = [pairs.select(F.col(end).alias("v"), F.xxhash64("a", "b").alias("cell")) for end in ("a", "b")]
    wanted = ends[0].union(ends[1]).join(points.select("v", "key"), "v")
    return _linked(rows, wanted, F.array("cell"), "wanted-pairs")


def set_points(rows: DataFrame) -> DataFrame:
    """v, key (struct of no_id, doc_id, text_key), size, keys, bits, at: the sets of runs that occur, the smallest row of each."""
    sketches = rows.mapInArrow(_sketches(frequencies(rows)), SKETCH)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    points = sketches.groupBy("v").agg(F.min(key).alias("key"), *[F.first(c).alias(c) for c in ("size", "keys", "bits", "at")])
    return settle(points, "points")


def near_copies(docs: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """v, key (struct of no_id, doc_id, text_key), root: the sets of runs that occur, the smallest row of each, its component."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), "text")
    points = set_points(rows)
    held = points.select(F.explode("keys").alias("key"), "v")
    stars = held.repartition("key").sortWithinPartitions("key").mapInArrow(_stars, "a long, b long")
    grouped = components(stars)
    grouped = settle(grouped.union(grouped.select("root", "root").distinct()).toDF("v", "group"), "groups")
    members = grouped.join(points.select("v", "size", "key"), "v")
    chunks = F.greatest(F.count("*") / chunk, F.sum("size") / CHUNK_RUNS)
    chunks = members.groupBy("group").agg(F.ceil(chunks).alias("n"))
    dealt = members.join(chunks, "group").select("v", "group", "n", F.pmod(F.xxhash64("v"), F.col("n")).alias("own"), "key")
    roots = components(_linked(rows, dealt, _cells(F.col("group"), F.col("own"), F.col("n")), "wanted"))
    points = points.join(roots, "v", "left").select("v", "key", F.coalesce("root", "v").alias("root"), "size", "bits", "at")
    points = settle(points, "labelled")
    more = settle(missed(rows, points), "missed")
    for end in ("a", "b"):
        more = more.join(points.select(F.col("v").alias(end), F.col("root").alias(f"root_{end}")), end)
    merged = components(more.select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))).toDF("root", "merged")
    return points.join(merged, "root", "left").select("v", "key", F.coalesce("merged", "root").alias("root"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest id, or of rows without ids the one of the
    smallest text hash; of rows equal in id and text one stays."""
    docs = only(docs, DOCUMENTS)
    keys = near_copies(docs).groupBy("root").agg(F.min("key").alias("key"))
    # null ids as a column of their own, so that the join and the repeats need the texts in the same place
    row = ["_key", "_no_id", "_id"]
    keys = keys.select(F.col("key.text_key").alias("_key"), F.col("key.no_id").alias("_no_id"), F.coalesce("key.doc_id", F.lit(0)).alias("_id"))
    named = {"_key": text_key(F.col("text")), "_no_id": F.col("doc_id").isNull(), "_id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0))}
    kept = docs.withColumns(named).join(keys, row, "left_semi")
    return kept.dropDuplicates(row).drop(*row)


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")
