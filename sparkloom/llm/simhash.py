"""SimHash near-duplicates by multi-index hashing.

`near_components` links 64-bit fingerprints of a few differing bits, without a miss. `drop_near_copies` takes wide
fingerprints to find texts of a high Jaccard similarity of their shingle sets, and checks what they link exactly.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, join_counted, key_filter, may_be_in
from sparkloom.llm.graph import connect
from sparkloom.llm.shingle import shingles
from sparkloom.llm.similar import BOTTOM, KEY, TOP, confirmed, set_key, shingle_set

#: Bits of the segments of 64-bit fingerprints and the radii of their balls; those for more than MANY fingerprints, which make
#: several times as many probes and leave buckets small. Neither misses a pair of 4 differing bits.
SEGMENTS, RADII = (22, 21, 21), (1, 1, 0)
MANY, MANY_SEGMENTS, MANY_RADII = 1 << 30, (32, 32), (2, 1)
#: Buckets up to this size are compared in one sweep of all rows; those above CROWD are split, so many times at most.
SMALL, CROWD, SPLITS = 8, 4096, 2
#: Share of the bits in which two texts of the least similarity differ on average; deviations above it that are searched.
FAR, DEVIATIONS = math.acos(2 * TOP / (BOTTOM + TOP)) / math.pi, 3
#: Pairs of the least similarity that meet in no segment at most, as computed.
MISS = 0.002
#: Fingerprints that one task compares, on average; a segment's value is frequent if it has over 1 / FREQUENT of all.
GATHERED, FREQUENT = 1 << 16, 4096
#: Texts of a component, at most, that those not like its first centre are compared with.
CENTRES = 8
#: Words of the fingerprints that decide which pairs are compared in full.
WIDE = 16
#: Components whose bits a task adds up before it hands them on.
SUMMED = 1 << 12
#: Fingerprints that may share a segment's value, however few there are.
RARE = 64
#: Up to so many of equal values all pairs are compared, so many places at a time.
SWEPT, STEP = 64, 1 << 18


def sign_bits(hashes: np.ndarray, words: int = 1) -> bytes:
    """SimHash of hashes, 64 bits a word, big-endian: a bit is 1 if it is set in over half of them.

    They count as they are for the first word and remixed for more; of no hashes it is zero.
    """
    set_in = np.zeros(64 * words, dtype=np.int64)
    steps = np.array([w * 0x9E3779B97F4A7C15 & 2**64 - 1 for w in range(words)], dtype=np.uint64)
    for at in range(0, len(hashes), 255):  # so many are counted in single bytes
        h = hashes[at : at + 255, None] + steps
        if words > 1:  # splitmix64
            m = h[:, 1:]
            m = (m ^ (m >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            m = (m ^ (m >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h[:, 1:] = m ^ (m >> np.uint64(31))
        set_in += np.unpackbits(h.astype(">u8").view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(2 * set_in > len(hashes)).tobytes()


def with_fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """docs with fingerprint, binary: the SimHash of each text's word shingles, repeats included; a null text is an empty one."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([sign_bits(shingles(t, width)) for t in texts], dtype=object)

    return docs.withColumn("fingerprint", of(F.coalesce("text", F.lit(""))))


def _probe(prints: np.ndarray, segments: Sequence[int], radii: Sequence[int]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets (segment and value) and the rows that go there.

    A row goes to its own value of each segment and to those with up to radius of its set bits cleared: two values that differ
    in that many bits at most both reach the value of the bits that they have in common.
    """
    rows, shift = np.arange(len(prints)), 64
    for number, (bits, radius) in enumerate(zip(segments, radii, strict=True)):
        shift -= bits
        value = (prints >> np.uint64(shift)) & np.uint64((1 << bits) - 1)
        base = np.uint64(number << 32)
        for cleared in range(radius + 1):
            for places in itertools.combinations(range(bits), cleared):
                flag = np.uint64(sum(1 << b for b in places))
                some = rows if not cleared else np.flatnonzero((value & flag) == flag)
                yield base | (value[some] ^ flag), some


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def _links_of(prints: np.ndarray, bucket: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of at most `most` bits that join what is near within each bucket; rows sorted by bucket, then print."""
    edges = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SMALL, sizes)
    left, right = [], []
    for d in range(1, SMALL):
        i = np.flatnonzero(small[:-d] & (bucket[d:] == bucket[:-d])) if len(bucket) > d else np.zeros(0, dtype=int)
        if not len(i):
            break
        i = i[_near(prints[i], prints[i + d]) <= most]
        left.append(i)
        right.append(i + d)
    for g in np.flatnonzero(sizes > SMALL):
        # From the smallest print not yet reached, in steps of at most `most` bits, till nothing more is near: each row is
        # reached once, so a bucket gives fewer links than it has rows.
        x, rest = prints[edges[g] : edges[g + 1]], np.arange(sizes[g])
        while len(rest):
            root, rest = rest[0], rest[1:]
            frontier = [root]
            while frontier and len(rest):
                near = _near(x[rest], x[frontier.pop()]) <= most
                frontier.extend(rest[near].tolist())
                left.append(np.full(near.sum(), edges[g] + root))
                right.append(edges[g] + rest[near])
                rest = rest[~near]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]).astype(np.int64), np.concatenate([none, *right]).astype(np.int64)


def near_links(prints: DataFrame, most: int, segments: Sequence[int] = SEGMENTS, radii: Sequence[int] = RADII) -> DataFrame:
    """a, b: links between distinct 64-bit fingerprints of at most `most` differing bits, enough to join all that are near.

    Fingerprints are cut into segments; two meet in a bucket if a segment's values are within its radius, and
    are then compared in full. Where sum(radius + 1) over all segments exceeds `most` no pair can be missed.
    Buckets that very many share are split over tasks. Fingerprints are of eight bytes, distinct and not null; of none, or one, there are no links; columns other than
    fingerprint are left out.
    """

    def numbers(column: pa.Array) -> np.ndarray:
        return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = numbers(batch.column(0))
            for bucket, rows in _probe(own, segments, radii):
                if len(rows):
                    yield pa.RecordBatch.from_arrays([pa.array(bucket.astype(np.int64)), pa.array(own[rows].astype(np.int64))], names=["bucket", "print"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush(bucket: np.ndarray, own: np.ndarray) -> pa.RecordBatch:
            a, b = _links_of(own.reshape(-1, 1), bucket, most)
            data = own.astype(">u8").reshape(-1, 1)
            return pa.RecordBatch.from_arrays([pa.array([data[i].tobytes() for i in side], pa.binary()) for side in (a, b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, own = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.uint64)
            # The last bucket may go on in the next batch.
            whole = int(np.searchsorted(bucket, bucket[-1]))
            if whole or (held and held[0][0][0] != bucket[0]):
                parts = [*held, (bucket[:whole], own[:whole])]
                yield flush(*(np.concatenate([p[i] for p in parts]) for i in (0, 1)))
                held = []
            held.append((bucket[whole:], own[whole:]))
        if held:
            yield flush(*(np.concatenate([p[i] for p in held]) for i in (0, 1)))

    probes = prints.select("fingerprint").mapInArrow(probe, "bucket long, print long")
    each = sum(math.comb(bits, k) for bits, radius in zip(segments, radii, strict=True) for k in range(radius + 1))
    met = _uncrowded(probes, most, segments, max(CROWD, prints.count() * each >> 20))
    met = met.repartition("bucket").sortWithinPartitions("bucket", "print")
    return met.mapInArrow(verify, "a binary, b binary")


def _uncrowded(probes: DataFrame, most: int, segments: Sequence[int], crowd: int) -> DataFrame:
    """bucket, print: probes, with the buckets of more than crowd rows split into smaller ones.

    Two prints of a bucket that differ in at most `most` bits agree on one of most + 1 parts of the bits that the bucket doesn't
    look at. So each row goes to a bucket for each part and its value there, and none that are near are parted. Buckets that are dense all over
    would multiply, so they are split SPLITS times; what is near there is soon joined.
    """

    def mask(of: range) -> int:
        return int(np.array([sum(1 << b for b in of)], dtype=np.uint64).view(np.int64)[0])

    starts = [64 - sum(segments[: k + 1]) for k in range(len(segments))]
    seen = F.array(*[F.lit(mask(range(a, a + bits))) for a, bits in zip(starts, segments, strict=True)])
    rows, done = probes.withColumn("seen", seen[F.shiftright("bucket", 32).cast("int")]), []

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bucket, own, seen = (batch.column(k).to_numpy().astype(np.uint64) for k in range(3))
            for look in np.unique(seen):
                some = np.flatnonzero(seen == look)
                free = [b for b in range(64) if not int(look) >> b & 1]
                for bits in np.array_split(free, most + 1):
                    part = np.uint64(sum(1 << int(b) for b in bits))
                    h = (bucket[some] ^ part) * np.uint64(0x9E3779B97F4A7C15) + (own[some] & part)
                    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                    both = np.full(len(some), look | part)
                    yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (h ^ (h >> np.uint64(31)), own[some], both)], names=["bucket", "print", "seen"])

    for _ in range(SPLITS):
        crowded = cut(rows.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > crowd).select("bucket"))
        if crowded.isEmpty():
            break
        # There are fewer than a million of them, see near_links; each split multiplies rows by most + 1.
        done.append(rows.join(F.broadcast(crowded), "bucket", "left_anti"))
        rows = cut(rows.join(F.broadcast(crowded), "bucket").mapInArrow(split, "bucket long, print long, seen long"))
    for other in done:
        rows = rows.unionByName(other)
    return rows.select("bucket", "print")


def near_components(docs: DataFrame, most: int = 4, width: int = 4) -> DataFrame:
    """Rows doc_id, text_hash (xxhash64 of the text), fingerprint, root and component_id, one for each row of docs.

    Fingerprints of at most `most` differing bits are linked; root is the smallest fingerprint that can be reached, component_id the
    smallest doc_id there (null if none has an id). Texts without words have fingerprint zero and are linked like any other.
    Equal fingerprints are one node, so copies make no links. Nulls are empty texts; repeated rows
    stay; an empty table gives an empty result; other columns of docs are left out.
    """
    rows = cut(with_fingerprints(docs.select("doc_id", "text"), width).select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"), "fingerprint"))
    nodes = cut(rows.groupBy("fingerprint").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")))
    segments, radii = (SEGMENTS, RADII) if nodes.count() <= MANY else (MANY_SEGMENTS, MANY_RADII)
    if sum(r + 1 for r in radii) <= most:
        raise ValueError(f"fingerprints are searched for up to {sum(r + 1 for r in radii) - 1} differing bits")
    roots = connect(near_links(nodes.select("fingerprint"), most, segments, radii))
    placed = cut(nodes.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn("root", F.coalesce("root", "fingerprint")))
    total = placed.agg(F.count("*").alias("nodes"), F.coalesce(F.sum("copies"), F.lit(0)).alias("rows")).first()
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    # Both a component and the copies of one fingerprint may be a large part of all rows.
    members = cut(join_counted(placed, least, "root", "members", total["nodes"]).select("fingerprint", "copies", "root", "component_id"))
    return join_counted(rows, members, "fingerprint", "copies", total["rows"]).select("doc_id", "text_hash", "fingerprint", "root", "component_id")


def far_bits(words: int) -> int:
    """Bits in which fingerprints of so many words differ for two sets of the least similarity, and DEVIATIONS more."""
    return round(64 * words * FAR + DEVIATIONS * math.sqrt(64 * words * FAR * (1 - FAR)))


@dataclass(frozen=True)
class Layout:
    """How wide fingerprints are searched: words of 64 bits, segments of so many bits, and those of them that name a group."""

    words: int
    bits: int
    segments: int
    top: int

    @classmethod
    def of(cls, count: int) -> Layout:
        """For so many fingerprints.

        A segment has half as many values as there are fingerprints, so that chance meetings stay few; there are so many segments
        that a pair of the least similarity has one of at most two differing bits with a chance of 1 - MISS. Where they have
        more bits than a fingerprint they overlap.
        """
        bits = min(30, max(12, math.ceil(math.log2(count + 1)) - 1))
        meet = sum(math.comb(bits, k) * FAR**k * (1 - FAR) ** (bits - k) for k in range(3))
        segments = math.ceil(math.log(MISS) / math.log(1 - meet))
        return cls(4 if bits * segments <= 512 else 8, bits, segments, min(bits - 4, max(2, math.ceil(math.log2((count + 1) / GATHERED)))))

    @property
    def most(self) -> int:
        """Differing bits of a link."""
        return far_bits(self.words)

    @property
    def close(self) -> int:
        """Differing bits within which one of very many fingerprints stands for another."""
        return int(64 * self.words * FAR)

    def values(self, prints: np.ndarray) -> Iterator[np.ndarray]:
        """The values of each segment; prints has a row of words for each fingerprint, of which the first ones count."""
        size, wide = 64 * self.words, np.concatenate([prints[:, : self.words], prints[:, :1]], axis=1)
        for k in range(self.segments):
            start = k * self.bits if self.bits * self.segments <= size else round(k * size / self.segments)
            word, off = divmod(start, 64)
            value = wide[:, word] << np.uint64(off)
            if off:
                value |= wide[:, word + 1] >> np.uint64(64 - off)
            yield value >> np.uint64(64 - self.bits)


def _matrix(column: pa.Array, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").astype(np.uint64).reshape(-1, words)


def _within(prints: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | int) -> np.ndarray:
    """Which of the pairs of rows differ in at most `most` bits; half of the words decide most pairs."""
    half = prints.shape[1] // 2
    apart = sum(np.bitwise_count(prints[a, k] ^ prints[b, k]).astype(np.int16) for k in range(half))
    near = apart <= most
    some = np.flatnonzero(near)
    apart = apart[some] + sum(np.bitwise_count(prints[a[some], k] ^ prints[b[some], k]).astype(np.int16) for k in range(half, prints.shape[1]))
    near[some] = apart <= (most if np.isscalar(most) else most[some])
    return near


def _meetings(value: np.ndarray) -> tuple[Iterator[tuple[np.ndarray, np.ndarray]], list[np.ndarray]]:
    """Pairs of places of equal values, by and by, where up to SWEPT share a value; and the places of each value of more."""
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    edges = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1], [True]]))
    sizes = np.diff(edges)
    small = np.repeat(sizes <= SWEPT, sizes)

    def swept() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for d in range(1, min(SWEPT, int(sizes.max(initial=1)))):
            for at in range(0, len(order) - d, STEP):
                end = min(at + STEP, len(order) - d)
                i = at + np.flatnonzero((ranked[at:end] == ranked[at + d : end + d]) & small[at:end])
                if len(i):
                    yield order[i], order[i + d]

    return swept(), [order[edges[g] : edges[g + 1]] for g in np.flatnonzero(sizes > SWEPT)]


def _pairs_of(value: np.ndarray, number: np.ndarray, prints: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with equal values and few differing bits (the sum of their reach), enough to join all such pairs.

    number is the row of each value.
    """
    left, right = [], []
    swept, large = _meetings(value)
    for a, b in swept:
        a, b = number[a], number[b]
        near = _within(prints, a, b, reach[a] + reach[b])
        left.append(a[near])
        right.append(b[near])
    for places in large:
        rest = np.unique(number[places])
        while len(rest):
            root, rest = rest[0], rest[1:]
            frontier = [root]
            while frontier and len(rest):
                at = frontier.pop()
                near = _near(prints[rest], prints[at]) <= reach[rest] + reach[at]
                frontier.extend(rest[near].tolist())
                left.append(np.full(near.sum(), at))
                right.append(rest[near])
                rest = rest[~near]
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _least_joined(a: np.ndarray, b: np.ndarray, count: int) -> np.ndarray:
    """For each of so many numbers the smallest that links (a, b) join it with."""
    label = np.arange(count)
    while True:
        low = np.minimum(label[a], label[b])
        now = label.copy()
        np.minimum.at(now, label[a], low)
        np.minimum.at(now, label[b], low)
        np.minimum.at(now, a, low)
        np.minimum.at(now, b, low)
        now = now[now]
        if (now == label).all():
            return label
        label = now


def _apart(value: np.ndarray, number: np.ndarray, prints: np.ndarray, labels: np.ndarray, words: int, most: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of rows with equal values, different labels and few differing bits, in the first words and in all; number is the row of each value."""
    left, right = [], []
    swept, large = _meetings(value)
    for a, b in swept:
        a, b = number[a], number[b]
        some = labels[a] != labels[b]
        a, b = a[some], b[some]
        near = _within(prints[:, :words], a, b, most[0])
        a, b = a[near], b[near]
        near = _within(prints, a, b, most[1])
        left.append(a[near])
        right.append(b[near])
    for places in large:
        own = np.unique(number[places])
        names, kind, times = np.unique(labels[own], return_inverse=True, return_counts=True)
        few = kind != times.argmax()  # of two in different labels one at least isn't in the most frequent
        for at in np.flatnonzero(few):
            others = own[(kind != kind[at]) & (~few | (np.arange(len(own)) > at))]
            others = others[_near(prints[others, :words], prints[own[at], :words]) <= most[0]]
            others = others[_near(prints[others], prints[own[at]]) <= most[1]]
            left.append(np.full(len(others), own[at]))
            right.append(others)
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def _groups(rows: DataFrame, layout: Layout) -> DataFrame:
    """rows, which have spot and print, once for each group that they go to; group: segment and top bits."""
    named = F.shiftright(F.col("spot").bitwiseAND((1 << 32) - 1), layout.bits - layout.top)
    groups = F.array(named, *(named.bitwiseXOR(F.lit(1 << b)) for b in range(layout.top)))
    group = (F.shiftright("spot", 32) * (1 << layout.top) + F.col("_name")).alias("group")
    return rows.withColumn("_name", F.explode(groups)).select(group, *rows.drop("spot").columns)


def _in_groups(rows: DataFrame, of: Callable[[int, pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """of (group, its rows) for each group of rows."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at, groups = 0, batch.column(0).to_numpy()
            while at < len(groups):
                end = int(np.searchsorted(groups, groups[at], "right"))
                if held and held[0].column(0)[0].as_py() != groups[at]:
                    yield from of(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(at, end - at))
                at = end
        if held:
            yield from of(held[0].column(0)[0].as_py(), pa.Table.from_batches(held))

    return rows.repartition("group").sortWithinPartitions("group").mapInArrow(each, schema)


def _spots(prints: DataFrame, layout: Layout, more: str) -> DataFrame:
    """print and one more column (long, or binary) of prints with spot, segment and value, for each segment."""
    kind = dict(prints.dtypes)[more].replace("bigint", "long")

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                words = len(batch.column(0)[0].as_py()) // 8
                for k, value in enumerate(layout.values(_matrix(batch.column(0), words))):
                    spot = pa.array((value | np.uint64(k << 32)).astype(np.int64))
                    yield pa.RecordBatch.from_arrays([spot, batch.column(0), batch.column(1)], names=["spot", "print", more])

    return prints.select("print", more).mapInArrow(spots, f"spot long, print binary, {more} {kind}")


def wide_links(prints: DataFrame, layout: Layout) -> DataFrame:
    """a, b: links between node numbers of wide fingerprints, enough to join all that are near and meet in a segment.

    prints has distinct node (long) and print (binary). A fingerprint is sent to the groups named by the top bits of its segments'
    values and of those with one of these bits flipped; in a group the rest of the ball is enumerated, so that all values of
    at most two differing bits meet. What meets is compared in full. Where very many have the same value, those near the
    smallest of them are linked to it and it stands for them with a wider reach: this loses no link, but may make more.
    """
    words, low = layout.words, layout.bits - layout.top
    each = _spots(prints, layout, "node")
    # Fewer than FREQUENT in each segment. Only their rows are looked at for the smallest, so that the count moves no fingerprint.
    often = cut(each.groupBy("spot").agg(F.count("*").alias("n")).filter(F.col("n") > max(RARE, prints.count() / FREQUENT)).select("spot"))
    hot = cut(each.join(F.broadcast(often), "spot"))
    least = hot.groupBy("spot").agg(F.min(F.struct("print", "node")).alias("one"))
    often = F.broadcast(cut(least.select("spot", F.col("one.print").alias("rep"), F.col("one.node").alias("rep_node"))))
    absorbed = (F.col("node") != F.col("rep_node")) & (bits_between(F.col("print"), F.col("rep"), words) <= layout.close)
    some = hot.join(often, "spot").filter(absorbed).select(F.col("node").alias("a"), F.col("rep_node").alias("b")).distinct()
    marked = each.join(often, "spot", "left")
    rest = marked.filter(~F.coalesce(absorbed, F.lit(False))).select("spot", "print", "node", F.coalesce(F.col("node") == F.col("rep_node"), F.lit(False)).alias("wide"))

    def links(group: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        prints = _matrix(rows["print"], words)
        number, value = _ball(layout, group, prints)
        # Two reach `most` together; one that stands for others reaches as much further as these may be from it.
        reach = layout.most / 2 + np.where(rows["wide"].to_numpy(), layout.close, 0)
        a, b = _pairs_of(value, number, prints, reach)
        # Each to the smallest node that it is joined with: fewer links than rows, and much the same ones in every group of a family.
        nodes = rows["node"].to_numpy()
        order = np.argsort(nodes, kind="stable")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order))
        least = nodes[order][_least_joined(rank[a], rank[b], len(order))][rank]
        some = np.flatnonzero(least != nodes)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(least[some])], names=["a", "b"])

    return some.unionByName(_in_groups(_groups(rest, layout), links, "a long, b long"))


def _ball(layout: Layout, group: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values for a group: the lower bits of each row's value, and of the group's own rows those with one bit flipped."""
    low = layout.bits - layout.top
    segment, name = divmod(group, 1 << layout.top)
    value = next(v for k, v in enumerate(layout.values(prints)) if k == segment)
    own = np.flatnonzero(value >> np.uint64(low) == name)
    value &= np.uint64((1 << low) - 1)
    flipped = [value[own] ^ np.uint64(1 << b) for b in range(low)]
    return np.concatenate([np.arange(len(prints)), *[own] * low]).astype(np.int32), np.concatenate([value, *flipped]).astype(np.uint32)


def wide_pairs(sets: DataFrame, layout: Layout) -> DataFrame:
    """a, b: all pairs of keys that meet as in wide_links and are near, but have different roots; each pair once.

    sets has key and root (binary of KEY bytes) and print, here of WIDE words: its first ones meet, and all of them decide. Of texts
    of a similarity of 0.65 one pair in fifty is near by 16 words, where it is two in three by 4.
    """
    words, low = layout.words, layout.bits - layout.top
    most = (layout.most, far_bits(WIDE))

    def pairs(group: int, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        prints = _matrix(rows["print"], WIDE)
        both = np.frombuffer(b"".join(rows["both"].to_pylist()), dtype=f"V{KEY}").reshape(-1, 2)
        labels = np.unique(both[:, 1].copy().view(">u8").reshape(-1, KEY // 8), axis=0, return_inverse=True)[1]
        number, value = _ball(layout, group, prints)
        a, b = _apart(value, number, prints, labels, words, most)
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
        # A pair is told in the first segment that it meets in, and there in one group of the two that may hold both.
        segment, name = divmod(group, 1 << layout.top)
        first = np.ones(len(pair), dtype=bool)
        for k, value in enumerate(layout.values(prints)):
            x, y = value[pair[:, 0]], value[pair[:, 1]]
            if k < segment:
                first &= np.bitwise_count(x ^ y) > 2
            if k == segment:
                x, y = x >> np.uint64(low), y >> np.uint64(low)
                flips = x ^ y
                lowest = flips & (~flips + np.uint64(1))
                # Of two that differ in one top bit both groups hold both; of those that differ in two the two between them do.
                first &= np.where(np.bitwise_count(flips) == 2, np.minimum(x ^ lowest, y ^ lowest), np.minimum(x, y)) == name
        pair = pair[first]
        if len(pair):
            keys = np.array([k.tobytes() for k in both[:, 0]], dtype=object)
            yield pa.RecordBatch.from_arrays([pa.array(keys[pair[:, 0]], pa.binary()), pa.array(keys[pair[:, 1]], pa.binary())], names=["a", "b"])

    rows = _spots(sets.select("print", F.concat("key", "root").alias("both")), layout, "both")
    return _in_groups(_groups(rows, layout), pairs, "a binary, b binary")


def bits_between(a: Column, b: Column, words: int) -> Column:
    """Differing bits of two binary columns of so many 64-bit words."""

    def word(x: Column, k: int, half: int) -> Column:
        return F.conv(F.hex(F.substring(x, 8 * k + 4 * half + 1, 4)), 16, 10).cast("long")

    return sum((F.bit_count(word(a, k, h).bitwiseXOR(word(b, k, h))) for k in range(words) for h in (0, 1)), F.lit(0))


def centres_of(linked: DataFrame, several: DataFrame, words: int) -> DataFrame:
    """scope, n, centre (key, print): a member of each component that others are likely to be like.

    For more than CENTRES members it is the one nearest to the majority of all their bits: edits of one text agree on that text's, whoever made
    them. Tasks add up the bits of components, so that a large one is no task of its own. For few members it is the first.
    """
    bits = 64 * words

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["scope", "sums"])

        for batch in batches:
            scope, where = np.unique(batch.column(0).to_numpy(), return_inverse=True)
            order = np.argsort(where, kind="stable")
            each = np.unpackbits(np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, bits // 8)[order], axis=1)
            sums = np.add.reduceat(each, np.searchsorted(where[order], np.arange(len(scope))), axis=0, dtype=np.int64) if len(scope) else each
            for k, total in zip(scope.tolist(), sums, strict=True):
                held[k] = held.get(k, 0) + total
            if len(held) > SUMMED:
                yield told()
                held = {}
        if held:
            yield told()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scope, total = None, None
        for batch in batches:
            for k, n, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if scope is not None and k != scope[0]:
                    yield majority(scope, total)
                    total = None
                own = np.frombuffer(sums, dtype=np.int64)
                scope, total = (k, n), own if total is None else total + own
        if scope is not None:
            yield majority(scope, total)

    def majority(scope: tuple[int, int], total: np.ndarray) -> pa.RecordBatch:
        print_ = np.packbits(2 * total > scope[1]).tobytes()
        return pa.RecordBatch.from_arrays([pa.array([scope[0]]), pa.array([scope[1]]), pa.array([print_], pa.binary())], names=["scope", "n", "middle"])

    big = several.filter(F.col("n") > CENTRES)
    total = linked.count()
    own = join_counted(linked, big, "scope", "n", total).select("scope", "n", "key", "print")
    sums = own.select("scope", "print").mapInArrow(partial, "scope long, sums binary").join(big, "scope").select("scope", "n", "sums")
    middle = cut(sums.repartition("scope").sortWithinPartitions("scope").mapInArrow(whole, "scope long, n long, middle binary"), rows=total)
    near = join_counted(linked, middle, "scope", "n", total).groupBy("scope")
    best = near.agg(F.min(F.struct(bits_between(F.col("print"), F.col("middle"), words).alias("apart"), "key", "print")).alias("best"))
    first = linked.groupBy("scope").agg(F.count("*").alias("n"), F.min(F.struct("key", "print")).alias("first"))
    best = best.select("scope", F.struct("best.key", "best.print").alias("best"))
    return cut(first.join(best, "scope", "left").select("scope", "n", F.coalesce("best", "first").alias("centre")), rows=total)


def drop_near_copies(docs: DataFrame, width: int = 5) -> DataFrame:
    """The rows of docs less all but one of each component of texts whose sets of width words are similar.

    Similar is a Jaccard similarity of TOP / BOTTOM or more. Fingerprints of the sets find what may be similar (see Layout for the
    chance that a pair at the bound is missed); within each component of near fingerprints similarity is then computed from
    the whole sets: first with one centre, then, for what isn't like it, with up to CENTRES others, and at last for all pairs
    that are near by wide fingerprints and not yet joined. What isn't similar is parted again. The row of the smallest doc_id (nulls last), then
    row hash, stays; of rows that agree in both the first by the plain ones of the other columns. All texts without words are alike, so one of them stays; a null text is an empty
    one; of repeated rows one stays; an empty table gives an empty result; columns of the input that are named like working ones are kept as they are.
    """
    count = docs.count()
    layout = Layout.of(count)

    @F.pandas_udf("binary")
    def key_and_print(texts: pd.Series) -> pd.Series:
        def one(text: str) -> bytes:
            every = shingle_set(text, width)
            return set_key(every) + sign_bits(every, layout.words)

        return pd.Series([one(t) for t in texts], dtype=object)

    @F.pandas_udf("binary")
    def wide_print(texts: pd.Series) -> pd.Series:
        return pd.Series([sign_bits(shingle_set(t, width), WIDE) for t in texts], dtype=object)

    text = F.coalesce("text", F.lit(""))
    # The key of a row, never null: a digest of its id and text.
    row = F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("~")), text)))
    both = docs.select("doc_id", row.alias("row"), key_and_print(text).alias("both"))
    rows = cut(both.select("doc_id", "row", F.substring("both", 1, KEY).alias("key"), F.substring("both", KEY + 1, 8 * layout.words).alias("print")))
    # A row for each distinct set; equal sets have equal fingerprints.
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    sets = cut(rows.groupBy("key").agg(F.min(order).alias("first"), F.min("print").alias("print"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("print")), rows=count)
    links = wide_links(sets.groupBy("node").agg(F.min("print").alias("print")), layout)
    roots = connect(links)
    placed = cut(sets.join(roots, "node", "left").withColumn("scope", F.coalesce("root", "node")).drop("root", "node"), rows=count)
    members = placed.agg(F.count("*")).first()[0]
    several = cut(placed.groupBy("scope").agg(F.count("*").alias("n")).filter("n > 1"), rows=members)
    linked = cut(join_counted(placed, several, "scope", "n", members).select("key", "scope", "print", F.col("first.row").alias("row")), rows=members)
    # Rows whose set is like none but its own are settled where they lie.
    marks = placed.join(linked.select("key", F.lit(True).alias("like")), "key", "left").filter("copies > 1 or like").select("key", "copies")
    open_ = cut(join_counted(rows, cut(marks, rows=members), "key", "copies", count).select("row"), rows=count)
    docs = docs.withColumn("_row", row)
    listed = may_be_in(key_filter(open_), "_row")
    texts = docs.filter(listed).select(F.col("_row").alias("row"), text.alias("text")).join(linked.select("row", "key"), "row").dropDuplicates(["row"]).select("key", "text")
    texts = cut(texts, "sets")

    def like(members: DataFrame, centres: DataFrame, centre: Column, total: int) -> DataFrame:
        """Similar pairs of members and the centres of their components."""
        stars = join_counted(members, centres, "scope", "n", total).select("key", "print", centre.alias("centre")).filter(F.col("key") != F.col("centre.key"))
        stars = stars.filter(bits_between(F.col("print"), F.col("centre.print"), layout.words) <= layout.most)
        return confirmed(cut(stars.select(F.col("centre.key").alias("a"), F.col("key").alias("b")), rows=total), texts, width)

    centres = centres_of(linked, several, layout.words)
    links = like(linked, centres, F.col("centre"), linked.count())
    rest = cut(linked.join(links.select(F.col("b").alias("key")).unionByName(centres.select("centre.key")), "key", "left_anti"), rows=members)
    slot = F.pmod(F.xxhash64("key"), F.lit(CENTRES)).alias("slot")
    slots = rest.groupBy("scope", slot).agg(F.min(F.struct("key", "print")).alias("centre"), F.count("*").alias("n"))
    more = cut(slots.groupBy("scope").agg(F.collect_list("centre").alias("centres"), F.sum("n").alias("n")), rows=members)
    links = links.unionByName(like(rest, more, F.explode("centres"), rest.count()))
    apart = cut(linked.join(connect(links).withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key")), rows=members)
    # Only components that are still in parts have pairs left.
    parts = cut(apart.groupBy("scope").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low != high").select("scope", "n"), rows=members)
    apart = join_counted(apart, parts, "scope", "n", linked.count()).join(texts, "key").select("key", "root", wide_print("text").alias("print"))
    links = links.unionByName(confirmed(cut(wide_pairs(cut(apart), layout)), texts, width))
    same = connect(links).withColumnRenamed("node", "key")
    found = placed.join(same, "key", "left").withColumn("root", F.coalesce("root", "key"))
    stay = found.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.row").alias("_row"))
    columns = docs.drop("_row").columns
    plain = [c for c, t in docs.dtypes if c not in ("doc_id", "text", "_row") and not t.startswith(("map", "array", "struct", "variant"))]
    one = F.min_by(F.struct(*columns), F.struct(F.lit(0), *plain)).alias("_one")
    return docs.filter(listed).join(stay, "_row", "left_semi").groupBy("_row").agg(one).select("_one.*").unionByName(docs.filter(~listed).select(*columns))
