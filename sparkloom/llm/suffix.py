"""Removal of long repeated strings with suffix arrays.

A 400-byte string has one anchor: the first of its 64-byte grams with the smallest hash. Equal strings have equal anchors
in the same place, so if a shard holds all text around the grams of some hashes, equal strings always share a
shard. Grams that occur once can't anchor a repeat, and their text goes nowhere. Each shard sorts the suffixes of its
text and finds long common prefixes. The text of a very frequent gram is split over several shards, whose strings then meet
by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, join_counted

LENGTH, GRAM = 400, 64
#: Texts of a gram that go to one shard, on average; bytes sorted at once.
SPLIT, BLOCK = 1024, 2 << 20
#: Runs of starts that are held before they are handed on.
HELD = 1 << 16
#: Symbols that the suffix sort starts with: as many as fit into 63 bits.
FIRST = 7


def gram_hashes(data: np.ndarray, gram: int = GRAM) -> np.ndarray:
    """A hash of the `gram` bytes from each place, by doubling; gram is a power of 2."""
    h = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    width = 1
    while width < gram:
        h = h[:-width] * np.uint64(0xD6E8FEB86659FD93) + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    return h * np.uint64(0xBF58476D1CE4E5B9)


def sliding(values: np.ndarray, width: int, pick: np.ufunc, fill: int) -> np.ndarray:
    """pick (minimum or maximum) over each run of width values."""
    n = len(values) - width + 1
    rows = -(-len(values) // width)
    padded = np.full(rows * width, fill, dtype=values.dtype)
    padded[: len(values)] = values
    blocks = padded.reshape(rows, width)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    behind = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(behind[:n], ahead[width - 1 : width - 1 + n])


def anchors(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of starts of `length`-byte strings that have the same anchor: its hash, first and last start."""
    if len(text) < length:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    h = gram_hashes(np.frombuffer(text, dtype=np.uint8), gram)
    width = length - gram + 1
    least = sliding(h, width, np.minimum, 2**64 - 1)
    # A gram is an anchor of some string if it is as small as the largest of the minima of those that hold it.
    ends = np.zeros(width - 1, dtype=np.uint64)
    anchor = np.flatnonzero(sliding(np.concatenate([ends, least, ends]), width, np.maximum, 0) == h)
    which = np.searchsorted(anchor, np.arange(len(least)))
    wrong = np.flatnonzero(h[anchor[which]] != least)
    while len(wrong):
        which[wrong] += 1
        wrong = wrong[h[anchor[which[wrong]]] != least[wrong]]
    first = np.flatnonzero(np.diff(which, prepend=-1))
    last = np.append(first[1:], len(which)) - 1
    return least[first].astype(np.int64), first, last


def suffix_array(data: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Sorted suffixes by Larsson and Sadakane's refinement: groups equal in h symbols are split by the rank h further on.

    room: bytes from each place to the end of its text, which counts as a symbol above all bytes, and the higher the later
    the text. The first groups are those equal in FIRST symbols, packed into one number.
    """
    n = len(data)
    symbols = np.concatenate([np.where(room > 0, data.astype(np.int64) + 1, 257), np.zeros(FIRST, dtype=np.int64)])
    key = symbols[:n].copy()
    for k in range(1, FIRST):
        key *= 258
        key += symbols[k : k + n]
    near = np.flatnonzero(room < FIRST - 1)  # nothing counts after the end
    key[near] -= key[near] % 258 ** (FIRST - 1 - room[near])
    order = np.argsort(key, kind="stable").astype(np.int32)
    ranked = key[order]
    # Suffixes with an end among these symbols are alone: the stable sort has put equal ones in the order of their texts.
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]]) | (room[order] < FIRST)
    rank = np.empty(n, dtype=np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    places, h = np.flatnonzero(~(new & np.append(new[1:], True))).astype(np.int32), FIRST  # of groups of more than one
    while len(places):
        suffix = order[places]
        key = rank[suffix].astype(np.int64)
        key *= n
        key += rank[suffix + h]  # equal in h symbols, so no end is among them
        by = np.argsort(key)
        key, suffix = key[by], suffix[by]
        order[places] = suffix
        split = np.concatenate([[True], key[1:] != key[:-1]])
        rank[suffix] = np.maximum.accumulate(np.where(split, places, 0))
        places = places[~(split & np.append(split[1:], True))]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, room: np.ndarray, order: np.ndarray, starts: np.ndarray, lengths: np.ndarray, most: int) -> np.ndarray:
    """For each place of order, bytes (at most `most`) shared with the suffix before, by Kasai's rule.

    A suffix shares at least one byte less than the one that starts before it in the text. The rule runs along all texts
    (from starts, of lengths) at the same time and compares eight bytes in a step; room is as for suffix_array.
    """
    n = len(data)
    place = np.empty(n, dtype=np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)])
    eight = np.ascontiguousarray(np.ndarray(n, dtype="<u8", buffer=padded, strides=(1,)))  # the bytes from each place
    out = np.zeros(n, dtype=np.int64)
    by_length = np.argsort(-lengths, kind="stable")
    starts, lengths = starts[by_length], lengths[by_length]
    shared = np.zeros(len(starts), dtype=np.int64)
    live = len(starts)
    for t in range(int(lengths.max(initial=0))):
        live = int(np.searchsorted(-lengths[:live], -t, side="left"))
        here = starts[:live] + t
        at = place[here]
        before = order[np.maximum(at - 1, 0)]
        limit = np.minimum(np.minimum(room[here], room[before]), most)
        s = np.maximum(shared[:live] - 1, 0)
        s[at == 0] = 0
        go = np.flatnonzero((at > 0) & (s < limit))
        while len(go):
            have = s[go]
            differ = eight[here[go] + have] ^ eight[before[go] + have]
            lowest = differ & (~differ + np.uint64(1))
            same = np.where(differ == 0, 8, np.bitwise_count(lowest - np.uint64(1)) // 8).astype(np.int64)
            s[go] = np.minimum(have + same, limit[go])
            go = go[(same == 8) & (s[go] < limit[go])]
        shared[:live] = s
        out[at] = s
    return out


def repeats_among(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each of the distinct texts, a class number for each start of a `length`-byte string; equal strings share it."""
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    starts = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    data = np.frombuffer(b"\0".join(texts) + b"\0", dtype=np.uint8)  # a place for the end of each text
    room = np.repeat(starts + lengths, lengths + 1) - np.arange(len(data))
    order = suffix_array(data, room)
    shared = common_prefixes(data, room, order, starts, lengths, length)
    classes = np.empty(len(data), dtype=np.int64)
    classes[order] = np.cumsum(shared < length)
    return [classes[s : s + n - length + 1] for s, n in zip(starts, lengths, strict=True)]


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last place of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return edges[::2], edges[1::2] - 1


def text_key(text: Column) -> Column:
    """MD5 of a text, never null: a join on a key that may be null filters its inputs, and an exchange of texts then can't be shared."""
    return F.coalesce(F.unhex(F.md5(F.coalesce(text, F.lit("")))), F.lit(b""))


class Shard:
    """Texts around grams as they come, sorted by gram: finds the repeated strings of each block of grams."""

    def __init__(self, length: int):
        self.length = length
        self.contexts: list[tuple[bytes, list[tuple[bytes, int]], int, int, bool]] = []
        self.bytes = 0
        self.out: list[tuple] = []

    def emit(self, members: list[tuple[bytes, int]], repeated: np.ndarray) -> None:
        for a, b in zip(*runs(repeated), strict=True):
            self.out += [(key, lo + int(a), lo + int(b), None, None) for key, lo in members]

    def group(self, number: int, split: bool, members: dict[bytes, tuple[list[tuple[bytes, int]], int]]) -> None:
        """All texts of one gram (or its share of them): each distinct text with the places it is at, and how often those occur."""
        if len(members) == 1 and not split:
            (text, (places, times)), = members.items()
            if times > 1:
                self.emit(places, np.ones(len(text) - self.length + 1, dtype=bool))
            return
        for text, (places, times) in members.items():
            self.contexts.append((text, places, times, number, split))
            self.bytes += len(text)
            if split and self.bytes >= 4 * BLOCK:  # the shard goes on; what is equal across its blocks is found by the merge
                self.sort()
        if self.bytes >= BLOCK:
            self.sort()

    def sort(self) -> None:
        if not self.contexts:
            return
        classes = repeats_among([c[0] for c in self.contexts], self.length)
        each = np.repeat([c[2] for c in self.contexts], [len(c) for c in classes])
        flat = np.concatenate(classes)
        counts = np.bincount(flat, weights=each)
        told: set[int] = set()
        for (text, places, _, _, split), own in zip(self.contexts, classes, strict=True):
            repeated = counts[own] > 1
            self.emit(places, repeated)
            if split:
                for k in range(len(own)):
                    if own[k] not in told:
                        told.add(own[k])
                        digest = hashlib.blake2b(text[k : k + self.length], digest_size=16).digest()
                        alone = not repeated[k]
                        self.out.append((places[0][0] if alone else None, places[0][1] + k if alone else None, None, digest, None))
        self.contexts, self.bytes = [], 0


RANGES = "key binary, first long, last long, digest binary, other int"
KINDS = (pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int32())


def _rows(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(KINDS)], names=["key", "first", "last", "digest", "other"])


def _columns(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names), strict=True)


def repeated_ranges(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """key, first, last: ranges of starts of the `length`-byte strings that also start anywhere else.

    texts has distinct key and text, and times, the rows that have the text.
    """

    def find_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows(batch: pa.RecordBatch, at: list[int], parts: list[tuple]) -> pa.RecordBatch:
            number = pa.array(np.repeat(at, [len(p[0]) for p in parts]))
            grams, first, last = (pa.array(np.concatenate(x)) for x in zip(*parts, strict=True))
            return pa.RecordBatch.from_arrays([batch.column(0).take(number), grams, first, last, batch.column(2).take(number)], names=["key", "gram", "first", "last", "times"])

        for batch in batches:
            at, parts, n = [], [], 0
            for i, text in enumerate(batch.column(1)):
                part = anchors(text.as_py().encode(), length)
                if len(part[0]):
                    at.append(i)
                    parts.append(part)
                    n += len(part[0])
                if n > HELD:
                    yield rows(batch, at, parts)
                    at, parts, n = [], [], 0
            if n:
                yield rows(batch, at, parts)

    long = texts.select("key", "text", "times")
    # Written, as it is read for the counts and for both parts of the join; some twenty bytes for each run of starts.
    found = cut(long.mapInArrow(find_anchors, "key binary, gram long, first long, last long, times long"), "grams")
    often = found.groupBy("gram").agg(F.sum("times").alias("_all"), F.count("*").alias("_places")).filter("_all > 1")
    often = often.select("gram", "_places", F.ceil(F.col("_places") / SPLIT).alias("parts"))
    part = F.when(F.col("parts") > 1, F.pmod(F.xxhash64("key", "first"), F.col("parts"))).otherwise(-1).alias("part")
    placed = join_counted(found.drop("times"), often, "gram", "_places", found.count())
    placed = placed.select("key", F.struct("gram", "first", "last", part).alias("run"))
    placed = placed.groupBy("key").agg(F.collect_list("run").alias("runs"))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ["gram", "part", "text", "key", "first", "times"], (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64())
        out, size = [], 0

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for key, text, times, own in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("key", "text", "times", "runs")), strict=True):
                key, data, times = key.as_py(), text.as_py().encode(), times.as_py()
                for r in own.as_py():
                    out.append((r["gram"], r["part"], data[r["first"] : r["last"] + length], key, r["first"], times))
                    size += r["last"] + length - r["first"]
                    if size > BLOCK:
                        yield rows()
                        out, size = [], 0
        if out:
            yield rows()

    around = long.join(placed, "key").mapInArrow(take, "gram long, part long, text binary, key binary, first long, times long")
    around = around.repartition("gram", "part").sortWithinPartitions("gram", "part")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, now, members = Shard(length), None, {}
        for batch in batches:
            for gram, part, text, key, first, times in _columns(batch, "gram", "part", "text", "key", "first", "times"):
                if (gram, part) != now:
                    if now is not None:
                        shard.group(now[0], now[1] >= 0, members)
                    now, members = (gram, part), {}
                places, n = members.get(text, ([], 0))
                places.append((key, first))
                members[text] = (places, n + times)
            if shard.out:
                yield _rows(shard.out)
                shard.out = []
        if now is not None:
            shard.group(now[0], now[1] >= 0, members)
        shard.sort()
        if shard.out:
            yield _rows(shard.out)

    both = around.mapInArrow(search, RANGES)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Strings of several shards, met by digest: a digest that is there more than once is repeated where a shard held it once.

        Ranges without a digest are settled and pass.
        """
        rest: list[tuple] = []

        def repeated(rows: list[tuple]) -> list[tuple]:
            digests = np.frombuffer(b"".join(r[2] for r in rows), dtype=">u8").reshape(-1, 2)
            names = (digests[:, 0].astype(np.uint64) << np.uint64(1)) ^ digests[:, 1].astype(np.uint64)
            order = np.argsort(names, kind="stable")
            ranked = names[order]
            several = np.searchsorted(ranked, names, "right") - np.searchsorted(ranked, names, "left") > 1
            exact: dict[bytes, int] = {}
            for i in np.flatnonzero(several):
                exact[rows[i][2]] = exact.get(rows[i][2], 0) + 1
            return [(k, a, a, None, None) for k, a, d in (rows[i] for i in np.flatnonzero(several)) if k is not None and exact[d] > 1]

        for batch in batches:
            digests = batch.column(batch.schema.get_field_index("digest"))
            settled = batch.filter(digests.is_null())
            if settled.num_rows:
                yield settled
            batch = batch.filter(digests.is_valid())
            if not batch.num_rows:
                continue
            rows = [*rest, *_columns(batch, "key", "first", "digest")]
            last = rows[-1][2]
            cut = len(rows)
            while cut and rows[cut - 1][2] == last:
                cut -= 1
            rest = rows[cut:]
            if cut and (out := repeated(rows[:cut])):
                yield _rows(out)
        if rest and (out := repeated(rest)):
            yield _rows(out)

    # One exchange for both kinds, so that the search runs once: strings meet by digest, settled ranges are dealt evenly.
    dealt = F.when(F.col("digest").isNull(), F.xxhash64("key", "first")).otherwise(F.xxhash64("digest"))
    return both.repartition(dealt).sortWithinPartitions("digest").mapInArrow(merge, RANGES).select("key", "first", "last")


ADDED = ("n_bytes", "n_removed", "n_spans", "kept")


def distinct_texts(docs: DataFrame) -> DataFrame:
    """key, text and times, the rows that have the text; a null text is an empty one."""
    return docs.groupBy(text_key(F.col("text")).alias("key")).agg(F.first(F.coalesce("text", F.lit(""))).alias("text"), F.count("*").alias("times"))


def stripped(texts: DataFrame, length: int) -> DataFrame:
    """_key, _times, n_bytes, n_removed, n_spans and kept of each of the distinct texts."""
    ranges = repeated_ranges(texts, length).groupBy("key").agg(F.collect_list(F.struct("first", "last")).alias("ranges"))

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_key", "_times", *ADDED]
        for batch in batches:
            out = []
            for key, text, times, own in zip(*(batch.column(batch.schema.get_field_index(n)) for n in ("key", "text", "times", "ranges")), strict=True):
                data, n = text.as_py().encode(), times.as_py()
                steps = np.zeros(len(data) + 1, dtype=np.int64)
                if n > 1 and len(data) >= length:
                    steps[0], steps[-1] = 1, -1
                for r in own.as_py() or []:
                    steps[r["first"]] += 1
                    steps[r["last"] + length] -= 1
                gone = np.cumsum(steps)[:-1] > 0
                kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
                out.append((key.as_py(), n, len(data), int(gone.sum()), len(runs(gone)[0]), kept))
            kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], names=names)

    return texts.join(ranges, "key", "left").mapInArrow(strip, "_key binary, _times long, n_bytes long, n_removed long, n_spans long, kept binary")


def drop_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept, the UTF-8 bytes (binary) that stay.

    Each byte goes that is covered by a `length`-byte string which also starts anywhere else, in the same row or
    another; all strings are judged on the input. A null text is an empty one. Equal texts of at least that length go whole; shorter
    ones stay. Matches never cross rows. An empty table gives an empty result; columns of the
    input named like an added one are replaced.
    """
    docs = docs.drop(*ADDED)
    result = cut(stripped(distinct_texts(docs), length), "stripped")
    rows = docs.withColumn("_key", text_key(F.col("text")))
    return join_counted(rows, result, "_key", "_times", docs.count()).select(*docs.columns, *ADDED)


def repeat_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every row, as by drop_repeats; what stays isn't shuffled."""
    numbers = ADDED[:3]
    result = cut(stripped(distinct_texts(docs), length).select("_key", "_times", *numbers, F.sha2("kept", 256).alias("kept_sha256")))
    rows = docs.select("doc_id", text_key(F.col("text")).alias("_key"))
    return join_counted(rows, result, "_key", "_times", docs.count()).select("doc_id", *numbers, "kept_sha256")
