"""Scores of a bigram language model whose counts are in a log-frequency Bloom filter that every worker holds.

Counts are gathered from the whole training corpus by shuffles of packed arrays. Those of words and of pairs of words are quantised to
powers of two and put in a Bloom filter; a text's probabilities come from probing it, level by level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparkloom.llm.common import cut, remove, shared_folder

#: Bits of the filter for each entry, and bits that an entry sets: about one entry in fifty seems to be there by chance.
ENTRY, HASHES = 8, 5
#: Bits of a filter that is broadcast (96 MB). A larger model goes out piece by piece; each piece is asked only for its own tokens.
PIECE = 3 << 28
#: A word is frequent if it is over 1 / FREQUENT of all tokens, so fewer than FREQUENT words are: their exact counts are broadcast.
FREQUENT = 1 << 21
#: Weight of the word's own probability against that after the word before it, in tokens.
PRIOR = 10.0
#: Tokens that a task counts before it hands counts on, and those that it scores at once; bytes of text in a part of the counts.
HELD, SCORED, PART = 1 << 20, 1 << 16, 1 << 22
#: Partial sums of logarithms are whole numbers of 1 / FIXED, so that their order doesn't matter.
FIXED = float(1 << 36)
#: Names of slots, which decide on the piece of a word.
SLOTS = 256
WORDS, PAIRS = 0, 1
END = np.uint64(xxh64_intdigest(b"\n"))
GOLD, LOW = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF)


def word_ids(text: str) -> np.ndarray:
    """XXH64 of each word, A-Z lower-cased, and END. Words are told apart by it."""
    words = text.encode().lower().split()
    out = np.full(len(words) + 1, END)
    out[:-1] = np.fromiter(map(xxh64_intdigest, words), dtype=np.uint64, count=len(words))
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    """splitmix64."""
    x = x + GOLD
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def before(ids: np.ndarray) -> np.ndarray:
    """The token before each; END before a text's first. Every text ends in END, so texts may follow each other."""
    return np.concatenate([np.array([END]), ids[:-1]])


def pair_keys(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """A key for each token with the one before it (first). The last 16 bits are the slots of both."""
    last = np.uint64(SLOTS - 1)
    return (_mix(first ^ _mix(ids)) & ~np.uint64(0xFFFF)) | ((first & last) << np.uint64(8)) | (ids & last)


def pack(x: np.ndarray) -> bytes:
    """64-bit numbers by planes of bytes, so that the upper bytes of small ones compress."""
    return np.ascontiguousarray(x.astype(np.uint64).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpack(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data), dtype=np.uint64)


def levels_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 0 for 0, else 1 + floor(log2)."""
    return np.frexp(counts.astype(np.float64))[1].astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The middle of the counts of a level."""
    return np.where(levels > 0, (3 * np.exp2(levels - 1.0) - 1) / 2, 0.0)


def entries(keys: np.ndarray, level: int) -> np.ndarray:
    """The hash of each key at a level."""
    return _mix(keys + np.uint64(level * int(GOLD) % 2**64))


def place(entry: np.ndarray, k: int, bits: np.ndarray | np.uint64) -> np.ndarray:
    """The kth bit of each entry in a segment of so many bits."""
    return (((entry & LOW) + np.uint64(k) * ((entry >> np.uint64(32)) | np.uint64(1))) & LOW) * bits >> np.uint64(32)


@dataclass
class Filter:
    """A log-frequency Bloom filter in segments, one for each part of the keys and kind; starts are in bytes.

    Unlike an array, a bytearray is loaded by a worker without a second copy.
    """

    parts: int
    starts: np.ndarray
    bits: bytearray

    def levels(self, keys: np.ndarray, kind: int) -> np.ndarray:
        """The quantised count of each key: the last level up to which all are there. Never too low; too high by chance."""
        segment = (part_of(keys, self.parts) << 1) | kind
        start = self.starts[segment].astype(np.uint64) << np.uint64(3)
        size = (self.starts[segment + 1] - self.starts[segment]).astype(np.uint64) << np.uint64(3)
        bits, out, level = np.frombuffer(self.bits, dtype=np.uint8), np.zeros(len(keys), dtype=np.int64), 1
        alive = np.flatnonzero(size > 0)
        while len(alive) and level <= 64:
            entry = entries(keys[alive], level)
            for k in range(HASHES):
                at = place(entry, k, size[alive]) + start[alive]
                hit = (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0
                alive, entry = alive[hit], entry[hit]
            out[alive] = level
            level += 1
        return out


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return (keys >> np.uint64(65 - parts.bit_length())).astype(np.int64)


def _by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, slice]]:
    """Parts of sorted keys, and where they are."""
    edges = np.searchsorted(keys, np.arange(1, parts, dtype=np.uint64) << np.uint64(65 - parts.bit_length()))
    edges = np.concatenate([[0], edges, [len(keys)]])
    for p in np.flatnonzero(np.diff(edges)):
        yield int(p), slice(edges[p], edges[p + 1])


COUNTED = "part int, kind int, keys binary, n binary, every binary"
MERGED = f"{COUNTED}, levels long, n_sum long, every_sum long, known long"


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[kind]) for i, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def gather_counts(docs: DataFrame, parts: int) -> DataFrame:
    """A table with the counts of each part of the keys, in order: of WORDS those in training and in all texts, of PAIRS in training.

    docs has text and training. Tasks add counts up before they are shuffled, as packed arrays by part; a part
    has a few millionths of the keys, and a frequent word is one key of it.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[list[np.ndarray]] = [[], []]  # texts that don't train, and that do
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            trained, rest = (np.concatenate([np.zeros(0, dtype=np.uint64), *own[k]]) for k in (1, 0))
            keys, every = np.unique(np.concatenate([trained, rest]), return_counts=True)
            some, n = np.unique(trained, return_counts=True)
            counts = np.zeros(len(keys), dtype=np.int64)
            counts[np.searchsorted(keys, some)] = n
            yield _batch([(p, WORDS, pack_sorted(keys[at]), pack(counts[at]), pack(every[at])) for p, at in _by_part(keys, parts)], COUNTED)
            if len(trained):
                keys, n = np.unique(pair_keys(before(trained), trained), return_counts=True)
                yield _batch([(p, PAIRS, pack_sorted(keys[at]), pack(n[at]), b"") for p, at in _by_part(keys, parts)], COUNTED)

        for batch in batches:
            for text, training in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                ids = word_ids(text.as_py())
                own[training].append(ids)
                size += len(ids)
                if size >= HELD:
                    yield from flush()
                    own, size = [[], []], 0
        if size:
            yield from flush()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []

        def merged() -> pa.RecordBatch:
            keys = np.concatenate([unpack_sorted(r[0]) for r in held])
            order = np.argsort(keys, kind="stable")
            keys = keys[order]
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            n, every = (np.add.reduceat(np.concatenate([unpack(r[i]) for r in held])[order], first).astype(np.int64) if held[0][i] else np.zeros(0, dtype=np.int64) for i in (1, 2))
            row = (*current, pack_sorted(keys[first]), pack(n), pack(every), int(levels_of(n).sum()), int(n.sum()), int(every.sum()), int((n > 0).sum()))
            return _batch([row], MERGED)

        for batch in batches:
            for part, kind, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (part, kind) != current and held:
                    yield merged()
                    held = []
                current = (part, kind)
                held.append(row)
        if held:
            yield merged()

    counted = docs.select("text", "training").mapInArrow(count, COUNTED)
    return cut(counted.repartition("part").sortWithinPartitions("part", "kind").mapInArrow(merge, MERGED), "counts")


def frequent_words(counts: DataFrame, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys, in order, and exact training counts of the words that are over 1 / FREQUENT of all tokens."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, n, every in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                some = unpack(every).astype(np.int64) * FREQUENT > total
                if some.any():
                    yield _batch([(pack_sorted(unpack_sorted(keys)[some]), pack(unpack(n)[some]))], "keys binary, n binary")

    found = counts.filter(F.col("kind") == WORDS).select("keys", "n", "every").mapInArrow(most, "keys binary, n binary").collect()
    none = np.zeros(0, dtype=np.uint64)
    keys, n = np.concatenate([none, *(unpack_sorted(r[0]) for r in found)]), np.concatenate([none, *(unpack(r[1]) for r in found)])
    order = np.argsort(keys)
    return keys[order], n[order].astype(np.int64)


def slot_groups(counts: DataFrame, levels: int) -> int:
    """Groups of slots, a power of two: pieces for each pair of groups then have at most PIECE bits."""
    if levels * ENTRY <= PIECE:
        return 1

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, SLOTS * SLOTS), dtype=np.int64)
        for batch in batches:
            for kind, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                slot = unpack_sorted(keys) & np.uint64(0xFF if kind == WORDS else 0xFFFF)
                total[kind] += np.bincount(slot.astype(np.int64), weights=levels_of(unpack(n)), minlength=SLOTS * SLOTS).astype(np.int64)
        kind, slot = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (kind, slot, total[kind, slot])], names=["kind", "slot", "n"])

    words, pairs = np.zeros(SLOTS, dtype=np.int64), np.zeros((SLOTS, SLOTS), dtype=np.int64)
    for kind, slot, n in counts.select("kind", "keys", "n").mapInArrow(slots, "kind long, slot long, n long").groupBy("kind", "slot").agg(F.sum("n")).collect():
        if kind == WORDS:
            words[slot] = n
        else:
            pairs[divmod(slot, SLOTS)] = n
    groups = 1
    while groups <= SLOTS:
        own = words.reshape(groups, -1).sum(axis=1)
        piece = pairs.reshape(groups, SLOTS // groups, groups, SLOTS // groups).sum(axis=(1, 3)) + own[:, None] + own[None, :]
        if int(piece.max()) * ENTRY <= PIECE:
            return groups
        groups *= 2
    raise ValueError(f"the model needs pieces of over {PIECE} bits")


def filter_segments(counts: DataFrame, groups: int) -> str:
    """The path of a table with the segments of all pieces, made in one pass where their counts lie: piece (a folder for each), segment, bits.

    Piece (i, j), numbered i * groups + j, has the pairs whose words are of these two groups of slots, and the words of either.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, kind, keys, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                keys, levels = unpack_sorted(keys), levels_of(unpack(n))
                keys, levels = keys[levels > 0], levels[levels > 0]
                for piece, some in (_words_of_pieces if kind == WORDS else _pairs_of_pieces)(keys, groups):
                    yield _batch([(piece, 2 * part + kind, _segment(keys[some], levels[some], ENTRY))], "piece int, segment int, bits binary")

    path = shared_folder(counts.sparkSession, "filter")
    found = counts.select("part", "kind", "keys", "n").mapInArrow(build, "piece int, segment int, bits binary")
    (found if groups == 1 else found.repartition(groups * groups, "piece")).write.partitionBy("piece").parquet(path)
    return path


def _pairs_of_pieces(keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces and the places of their pairs."""
    piece = group_of(keys >> np.uint64(8), groups) * groups + group_of(keys, groups)
    yield from _by_value(piece)


def _words_of_pieces(keys: np.ndarray, groups: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces and the places of their words."""
    of = dict(_by_value(group_of(keys, groups)))
    for i in range(groups):
        for j in range(groups):
            own = [of[g] for g in {i, j} if g in of]
            if own:
                yield i * groups + j, np.concatenate(own)


def _by_value(x: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each value and its places, in order."""
    order = np.argsort(x, kind="stable")
    edges = np.flatnonzero(np.diff(x[order], prepend=-1, append=-1)) if len(x) else []
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        yield int(x[order[a]]), order[a:z]


def _segment(keys: np.ndarray, levels: np.ndarray, each: int) -> bytes:
    """A segment with all levels of these keys, of so many bits each."""
    size = -(-int(levels.sum()) * each // 8)
    is_set = np.zeros(8 * size, dtype=bool)
    for level in range(1, int(levels.max()) + 1):
        entry = entries(keys[levels >= level], level)
        for k in range(HASHES):
            is_set[place(entry, k, np.uint64(8 * size))] = True
    return np.packbits(is_set, bitorder="little").tobytes()


def load_filter(spark: SparkSession, path: str, parts: int, piece: int) -> Filter:
    """A piece of what filter_segments has written."""
    found = spark.read.schema("segment int, bits binary, piece int").parquet(path).filter(F.col("piece") == piece)
    sizes = np.zeros(2 * parts, dtype=np.int64)
    for r in found.select("segment", F.octet_length("bits")).collect():
        sizes[r[0]] = r[1]
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bits = bytearray(int(starts[-1]))
    for r in found.select("segment", "bits").toLocalIterator():  # the driver holds it once, and a task's rows
        bits[starts[r[0]] : starts[r[0] + 1]] = r[1]
    return Filter(parts, starts, bits)


def build_filter(counts: DataFrame, parts: int, piece: tuple[int, int], groups: int) -> Filter:
    """The filter of the pairs whose words are of these two groups of slots, and of the words of either."""
    path = filter_segments(counts, groups)
    found = load_filter(counts.sparkSession, path, parts, piece[0] * groups + piece[1])
    remove(counts.sparkSession, path)
    return found


def group_of(keys: np.ndarray, groups: int) -> np.ndarray:
    return ((keys & np.uint64(SLOTS - 1)).astype(np.int64) * groups) >> 8


def log_probabilities(words: np.ndarray, levels: np.ndarray, first: np.ndarray, own: np.ndarray, model: Filter, space: float) -> np.ndarray:
    """log10 of the smoothed probability of each token (own) after the one before it (first), by probes; both are places in words, whose levels are given."""
    # A pair is no more frequent than either word, which shows most pairs that seem to be there by chance.
    most = np.minimum(levels[own], levels[first])
    both = np.zeros(len(own), dtype=np.int64)
    some = np.flatnonzero(most > 0)
    both[some] = np.minimum(model.levels(pair_keys(words[first[some]], words[own[some]]), PAIRS), most[some])
    return np.log10((count_of(both) + PRIOR * (count_of(levels) + 1)[own] / space) / (count_of(levels) + PRIOR)[first])


def _codes(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of whole texts, in order, and the places there of the token before each and of each."""
    words, own = np.unique(ids, return_inverse=True)
    # A text's last token is END, which also stands before its first.
    return words, np.concatenate([own[-1:], own[:-1]]), own


def cells(ids: np.ndarray, row: np.ndarray, groups: int) -> Iterator[list[bytes]]:
    """The tokens of whole texts, dealt to the pieces that have their pairs: for some tokens at a time a cell for each piece.

    row has the number of each token's text, in order. A cell has its distinct words and, for each token, the places there of it and the
    one before it, and its row: a third of the bytes of both words. Each token is in one cell.
    """
    words, first, own = _codes(ids)
    group, local = group_of(words, groups), np.empty(len(words), dtype=np.uint32)
    for at in range(0, len(ids), HELD):
        v, w, r = first[at : at + HELD], own[at : at + HELD], row[at : at + HELD]
        out = [b""] * groups**2
        for piece, some in _by_value(group[v] * groups + group[w]):
            a, b = v[some], w[some]
            used = np.unique(np.concatenate([a, b]))
            local[used] = np.arange(len(used), dtype=np.uint32)
            head = np.array([len(used), len(some)], dtype=np.uint64).tobytes()
            out[piece] = head + pack_sorted(words[used]) + b"".join(map(_pack_small, (local[a], local[b], np.diff(r[some], prepend=0))))
        yield out


def read_cell(cell: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """words, first, own, row of a cell."""
    n_words, n = np.frombuffer(cell[:16], dtype=np.uint64).tolist()
    at = 16 + 8 * n_words
    first, own, steps = (_unpack_small(cell[at + 4 * n * k : at + 4 * n * (k + 1)]) for k in range(3))
    return unpack_sorted(cell[16:at]), first, own, np.cumsum(steps)


def _pack_small(x: np.ndarray) -> bytes:
    """As pack, for numbers under 2^32."""
    return np.ascontiguousarray(x.astype(np.uint32).view(np.uint8).reshape(-1, 4).T).tobytes()


def _unpack_small(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T).view(np.uint32).ravel().astype(np.int64)


def texts_at_once(texts: pa.Array, tokens: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Word ids of some texts at a time, of so many tokens or a little more, and the number of the first."""
    at, held, size = 0, [], 0
    for i, t in enumerate(texts):
        held.append(word_ids(t.as_py()))
        size += len(held[-1])
        if size >= tokens:
            yield at, held
            at, held, size = i + 1, [], 0
    if held:
        yield at, held


def rare_scores(tails: DataFrame, counts: DataFrame, parts: int, space: float) -> DataFrame:
    """_row, base, known: what the words in tail (ids) add to a row's base score, in 1 / FIXED, and to its known words.

    Ids meet the exact counts of their part; a word in tail is at most 1 / FREQUENT of all tokens, so none is hot.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, tail = batch.column(0).to_numpy(), [np.frombuffer(t, dtype=np.uint64) for t in batch.column(1).to_pylist()]
            for high in np.unique(rows >> 32):
                some = np.flatnonzero(rows >> 32 == high)
                keys = np.concatenate([tail[i] for i in some])
                low = np.repeat(rows[some] & 0xFFFFFFFF, [len(tail[i]) for i in some])
                order = np.argsort(keys, kind="stable")
                keys, low = keys[order], low[order]
                out = [(p, 1, pack_sorted(keys[at]), low[at].astype(np.uint32).tobytes(), int(high)) for p, at in _by_part(keys, parts)]
                if out:
                    yield _batch(out, "part int, kind int, keys binary, n binary, high long")

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, known, n = None, np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def told() -> pa.RecordBatch:
            rows, where = np.unique(np.concatenate([h[0] for h in held]), return_inverse=True)
            sums = [np.zeros(len(rows), dtype=np.int64) for _ in (1, 2)]
            for i, s in enumerate(sums, 1):
                np.add.at(s, where, np.concatenate([h[i] for h in held]))
            return pa.RecordBatch.from_arrays(list(map(pa.array, (rows, *sums))), names=["_row", "base", "known"])

        for batch in batches:
            for p, kind, keys, data, high in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if kind == 0:
                    part, known, n = p, unpack_sorted(keys), unpack(data).astype(np.int64)
                    continue
                keys = unpack_sorted(keys)
                count = np.zeros(len(keys), dtype=np.int64)
                if part == p:
                    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                    count = np.where(known[at] == keys, n[at], 0)
                rows = np.frombuffer(data, dtype=np.uint32).astype(np.int64) | (high << 32)
                held.append((rows, np.rint(np.log10((count + 1) / space) * FIXED).astype(np.int64), (count > 0).astype(np.int64)))
                size += len(keys)
                if size >= HELD:
                    yield told()
                    held, size = [], 0
        if held:
            yield told()

    asked = tails.select("_row", "tail").mapInArrow(ask, "part int, kind int, keys binary, n binary, high long")
    exact = counts.filter(F.col("kind") == WORDS).select("part", F.lit(0).alias("kind"), "keys", "n", F.lit(0).cast("long").alias("high"))
    met = exact.unionByName(asked).repartition("part").sortWithinPartitions("part", "kind")
    return met.mapInArrow(answer, "_row long, base long, known long").groupBy("_row").agg(F.sum("base").alias("base"), F.sum("known").alias("known"))


def score_texts(docs: DataFrame, training: Column) -> DataFrame:
    """doc_id, training, n_tokens, n_known, train_tokens, base_score and score of every row of docs.

    Tokens are a text's words, A-Z lower-cased, and one end. The rows for which training is true give the counts. base_score adds up
    log10((c + 1) / (N + V + 1)) with exact counts of single tokens; score is log10 of the text's probability in the model, of bigrams with
    Dirichlet smoothing: (c(v w) + PRIOR * (c(w) + 1) / (N + V + 1)) / (c(v) + PRIOR), where counts c are what a log-frequency Bloom filter
    gives: the middle of 1, 2-3, 4-7 and so on, seldom too high (see ENTRY) and never too low; c(v w) is at most c(v) and c(w).

    The filter is made where the counts lie and broadcast in pieces of at most PIECE bits. One piece is all there is for some
    70 million different pairs; beyond that words fall into groups of slots, and each pair of groups is a piece. Texts are then taken apart once, and
    each token is dealt to the piece of its pair, so that the work doesn't grow with the number of pieces.
    A null text is an empty one: its only token is the end. A null in training is false; repeated rows count and are scored each; without
    training rows every count is 0 and N + V + 1 is 1; an empty table gives an empty result; other columns of docs are left out.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    parts = max(16, 1 << (int(rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]) // PART).bit_length())
    counts = gather_counts(rows, parts)
    words = F.col("kind") == WORDS
    got = counts.agg(*(F.coalesce(c, F.lit(0)) for c in (F.sum("levels"), F.sum(F.when(words, F.col("n_sum"))), F.sum("every_sum"), F.sum(F.when(words, F.col("known")))))).first()
    levels, tokens, every, distinct = map(int, got)
    space, groups = float(tokens + distinct + 1), slot_groups(counts, levels)
    frequent = spark.sparkContext.broadcast(frequent_words(counts, every))
    model = spark.sparkContext.broadcast(build_filter(counts, parts, (0, 0), groups)) if groups == 1 else None
    names = [f"cell{k}" for k in range(groups**2)] if groups > 1 else []
    kind = dict(rows.dtypes)["doc_id"].replace("bigint", "long")
    schema = f"_row long, training boolean, n_tokens long, known long, base double, score long, tail binary, doc_id {kind}{''.join(f', {c} binary' for c in names)}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n = frequent.value
        for batch in batches:
            for at, held in texts_at_once(batch.column(1), HELD if names else SCORED):
                ids = np.concatenate(held)
                sizes = np.array([len(h) for h in held])
                starts = np.cumsum(sizes) - sizes
                found = np.minimum(np.searchsorted(keys, ids), max(0, len(keys) - 1))
                common = keys[found] == ids if len(keys) else np.zeros(len(ids), dtype=bool)
                count = np.where(common, n[found], 0) if len(keys) else np.zeros(len(ids), dtype=np.int64)
                base = np.add.reduceat(np.where(common, np.log10((count + 1) / space), 0.0), starts)
                known = np.add.reduceat((count > 0).astype(np.int64), starts)
                own = np.zeros(len(held))
                if not names:
                    words, *places = _codes(ids)
                    own = np.add.reduceat(log_probabilities(words, model.value.levels(words, WORDS), *places, model.value, space), starts)
                ends = np.cumsum(np.add.reduceat((~common).astype(np.int64), starts))
                rare = ids[~common].tobytes()
                tails = [rare[8 * a : 8 * z] for a, z in zip([0, *ends[:-1]], ends, strict=True)]
                some = batch.slice(at, len(held))
                columns = [some.column(3), some.column(2), pa.array(sizes), pa.array(known), pa.array(base), pa.array(np.rint(own * FIXED).astype(np.int64)), pa.array(tails, pa.binary()), some.column(0)]
                columns += [pa.nulls(len(held), pa.binary())] * len(names)
                fields = [c.split()[0] for c in schema.split(", ")]
                yield pa.RecordBatch.from_arrays(columns, names=fields)
                if names:
                    # Rows of cells have the first _row of their texts and, besides, nothing but cells.
                    row = some.column(3).to_numpy()
                    for dealt in cells(ids, np.repeat(row - row[0], sizes), groups):
                        rest = [pa.nulls(1, c.type) for c in columns[1 : -len(names)]]
                        yield pa.RecordBatch.from_arrays([pa.array(row[:1]), *rest, *(pa.array([c], pa.binary()) for c in dealt)], names=fields)

    first = cut(rows.select("doc_id", "text", "training", F.monotonically_increasing_id().alias("_row")).mapInArrow(score, schema), "scores")
    for sent in filter(None, (model, frequent)):
        sent.destroy()
    texts = first.filter(F.col("n_tokens").isNotNull()).drop(*names)
    out = texts.drop("tail").join(rare_scores(texts.filter(F.octet_length("tail") > 0), counts, parts, space).withColumnsRenamed({"base": "_base", "known": "_known"}), "_row", "left")
    none = F.lit(0).cast("long")
    total = F.col("score")
    if names:
        path, found = filter_segments(counts, groups), []
        for k, name in enumerate(names):
            sent = spark.sparkContext.broadcast(load_filter(spark, path, parts, k))
            found.append(cut(_piece_scores(first, name, sent, space), "piece"))
            sent.destroy()
        remove(spark, path)
        out = out.join(_added(reduce(DataFrame.unionByName, found)), "_row")
        total = total + F.col("more")
    out = cut(out.select("doc_id", "training", "n_tokens", (F.col("known") + F.coalesce("_known", none)).alias("n_known"), F.lit(tokens).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("_base", none) / FIXED).alias("base_score"), (total / FIXED).alias("score")))
    for done in (counts, first, *(found if names else [])):
        remove(spark, done)
    return out


def _piece_scores(first: DataFrame, cell: str, model: Broadcast, space: float) -> DataFrame:
    """_row, sums: what the tokens of a piece add to the scores of the rows from _row on, in 1 / FIXED. Only the piece's own column is read."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, data in zip(batch.column(0), batch.column(1), strict=True):
                words, before_, own, row = read_cell(data.as_py())
                levels, sums = model.value.levels(words, WORDS), np.zeros(row[-1] + 1, dtype=np.int64)
                for a in range(0, len(own), SCORED):
                    z = a + SCORED
                    some = np.rint(log_probabilities(words, levels, before_[a:z], own[a:z], model.value, space) * FIXED).astype(np.int64)
                    starts = np.flatnonzero(np.diff(row[a:z], prepend=-1))
                    sums[row[a:z][starts]] += np.add.reduceat(some, starts)
                yield pa.RecordBatch.from_arrays([pa.array([at.as_py()], pa.int64()), pa.array([pack(sums)], pa.binary())], names=["_row", "sums"])

    return first.filter(F.octet_length(cell) > 0).select("_row", cell).mapInArrow(score, "_row long, sums binary")


def _added(sums: DataFrame) -> DataFrame:
    """_row, more: the sums of all pieces by row."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, np.zeros(0, dtype=np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(total))), pa.array(total)], names=["_row", "more"])

        for batch in batches:
            for row, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if row != at:
                    if at is not None:
                        yield told()
                    at, total = row, np.zeros(0, dtype=np.int64)
                own = unpack(data).view(np.int64)
                if len(own) > len(total):
                    total, own = own.copy(), total
                total[: len(own)] += own
        if at is not None:
            yield told()

    return sums.repartition("_row").sortWithinPartitions("_row").mapInArrow(add, "_row long, more long")


def held_out(doc_id: Column, parts: int = 7, part: int = 2) -> Column:
    """Whether the CRC-32 of doc_id as text, modulo parts, is part; an id that is null is the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts == part
