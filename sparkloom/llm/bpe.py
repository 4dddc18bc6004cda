"""Byte-level BPE encoding by backtracking from longest matches, and decoding."""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

#: Bounds of what a worker remembers: pieces with their ids, and pairs of tokens.
PIECES, PAIRS = 100_000, 150_000
#: Longer texts are matched piece by piece instead of in one list.
LISTED = 1_000_000
#: Characters of text whose results are held before they are handed on.
HELD = 1 << 21


class Vocabulary(dict):
    """Token ids of a rank file; as a dict, ids of pieces (packed, little-endian, 32 bits), as found so far."""

    def __init__(self, rank_file: bytes, pattern: str):
        self.pattern = regex.compile(pattern)
        lines = [line.split() for line in rank_file.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in lines}
        self.tokens = {i: t for t, i in self.ranks.items()}
        # Bytes are the first 256 code points of Latin-1, so the automaton's strings have a character for each.
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t.decode("latin-1"), i)
        self.automaton.make_automaton()
        self.by_chars = {t.decode("latin-1"): i for t, i in self.ranks.items()}
        self.most = max(map(len, self.ranks))
        self.older: dict[str, bytes] = {}
        self.length = {i: len(t) for t, i in self.ranks.items()}
        self.shorter: dict[int, int] = {}  # the longest token that is a proper prefix
        for t, i in self.ranks.items():
            for k in range(len(t) - 1, 0, -1):
                if (j := self.ranks.get(t[:k])) is not None:
                    self.shorter[i] = j
                    break
        # The pair whose merge makes each token: the only two smaller tokens that stay apart until then.
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.apart: dict[tuple[int, int], bool] = {}
        for i in sorted(self.tokens):
            t = self.tokens[i]
            self.parts[i] = (i, i)
            for k in range(1, len(t)):
                a, b = self.ranks.get(t[:k]), self.ranks.get(t[k:])
                if a is not None and b is not None and a < i and b < i and self._stay_apart(a, b):
                    self.parts[i] = (a, b)
                    self.merged[a, b] = i
                    break
        self.apart.clear()
        del self.ranks

    def _stay_apart(self, a: int, b: int) -> bool:
        """Whether the merges of a's and b's bytes, side by side, end in just these two tokens.

        Merges are undone latest first, on the side that was made later; a merge across the border that comes
        before those still undone would have happened.
        """
        limit = 1 << 62
        while True:
            made = self.merged.get((a, b))
            if made is not None and made < limit:
                return False
            if a > b:
                limit, a = a, self.parts[a][1]
                if a == limit:  # a byte: on with the other side
                    limit, b = b + 1, self.parts[b][0]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.parts[b][0]
                if b + 1 == limit:
                    limit, a = a, self.parts[a][1]
                    if a == limit:
                        return True

    def compatible(self, a: int, b: int) -> bool:
        known = self.apart.get((a, b))
        if known is None:
            if len(self.apart) >= PAIRS:
                self.apart.clear()
            known = self.apart[a, b] = self._stay_apart(a, b)
        return known

    def _longest(self, chars: str, at: int) -> int:
        """The longest token that chars has at this place."""
        return next(self.automaton.iter_long(chars[at : at + self.most]))[1]

    def ids(self, piece: str) -> list[int]:
        """Token ids of a piece: from each place the longest match that is compatible with the token before, with a step back where none is."""
        chars = piece if piece.isascii() else piece.encode().decode("latin-1")
        whole = self.by_chars.get(chars)
        if whole is not None:
            return [whole]
        n, length, shorter, apart = len(chars), self.length, self.shorter, self.apart
        out: list[int] = []
        dead: set[int] = set()
        at, token, last = 0, self._longest(chars, 0), -1
        while True:
            end = at + length[token]
            if end not in dead and (last < 0 or (apart[last, token] if (last, token) in apart else self.compatible(last, token))):
                out.append(token)
                if end == n:
                    return out
                at, last, token = end, token, self._longest(chars, end)
            elif token in shorter:
                token = shorter[token]
            else:  # nothing goes on from here
                dead.add(at)
                token = out.pop()
                at -= length[token]
                last = out[-1] if out else -1

    def __missing__(self, piece: str) -> bytes:
        packed = self.older.get(piece)
        if packed is None:
            packed = array("I", self.ids(piece)).tobytes()
        if len(piece) <= 64:
            if len(self) >= PIECES:
                self.older = dict(self)
                self.clear()
            self[piece] = packed
        return packed

    def encode(self, text: str) -> bytes:
        if len(text) <= LISTED:
            return b"".join(map(self.__getitem__, self.pattern.findall(text)))
        return b"".join(self[m[0]] for m in self.pattern.finditer(text))

    def decode(self, packed: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, array("I", packed)))


_loaded: dict[tuple[int, str], Vocabulary] = {}


def _vocabulary(rank_file: bytes, pattern: str) -> Vocabulary:
    key = (hash(rank_file), pattern)
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = Vocabulary(rank_file, pattern)
    return _loaded[key]


def _sent(df: DataFrame, rank_path: str) -> Broadcast:
    """The rank file's bytes: the driver reads them (a vocabulary, of a fixed size) and broadcasts them."""
    with open(rank_path, "rb") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode_texts(docs: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """docs with n_tokens, ids (packed little-endian unsigned 32-bit integers) and decoded (the bytes read back from ids).

    Each match of pattern is encoded by itself, without special tokens. A null or empty text has no ids. Long texts
    are encoded whole, in time linear in their length; results leave a task in pieces of about HELD characters of
    text. Columns of the input named like an added one are replaced; repeated rows are encoded alike; an empty
    table gives an empty result.
    """
    ranks = _sent(docs, rank_path)
    docs = docs.drop("n_tokens", "ids", "decoded")
    at, names = docs.columns.index("text"), [*docs.columns, "n_tokens", "ids", "decoded"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(ranks.value, pattern)
        for batch in batches:
            texts, begun, held = batch.column(at), 0, 0
            ids, decoded = [], []
            for i in range(batch.num_rows):
                text = texts[i].as_py() or ""
                ids.append(v.encode(text))
                decoded.append(v.decode(ids[-1]))
                held += len(text)
                if held >= HELD or i + 1 == batch.num_rows:
                    n_tokens = pa.array([len(x) // 4 for x in ids], pa.int64())
                    part = batch.slice(begun, len(ids))
                    columns = [*part.columns, n_tokens, pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    ids, decoded, begun, held = [], [], i + 1, 0

    kind = StructType([*docs.schema.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", BinaryType())])
    return docs.mapInArrow(encode, kind)


def decode_ids(encoded: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """encoded with decoded made anew from its packed ids; null ids give null."""
    ranks = _sent(encoded, rank_path)
    encoded = encoded.drop("decoded")
    at, names = encoded.columns.index("ids"), [*encoded.columns, "decoded"]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _vocabulary(ranks.value, pattern)
        for batch in batches:
            read = pa.array([None if x is None else v.decode(x) for x in batch.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, read], names=names)

    return encoded.mapInArrow(decode, StructType([*encoded.schema.fields, StructField("decoded", BinaryType())]))
