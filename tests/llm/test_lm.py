"""The language model against plain counts, with and without pieces, and on texts that it hasn't seen."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    return [*(w.translate({c: c + 32 for c in range(65, 91)}) for w in WORD.findall(text or "")), None]


def middle(n):
    """What a quantised count stands for."""
    return (3 * 2 ** (n.bit_length() - 1) - 1) / 2 if n else 0.0


def plain(rows):
    """Rows (doc_id, text): held_out, n_tokens, n_known, N, base score and the score of a filter without errors, of each."""
    held = [zlib.crc32(("" if k is None else str(k)).encode()) % 7 == 2 for k, _ in rows]
    texts = [tokens(t) for _, t in rows]
    one, two = Counter(), Counter()
    for t, h in zip(texts, held, strict=True):
        if not h:
            one.update(t)
            two.update(zip([None, *t[:-1]], t, strict=True))
    n, space = one.total(), one.total() + len(one) + 1
    out = []
    for (k, _), t, h in zip(rows, texts, held, strict=True):
        score = 0.0
        for v, w in zip([None, *t[:-1]], t, strict=True):
            both = middle(two[v, w])
            score += math.log10((both + 10 * (middle(one[w]) + 1) / space) / (middle(one[v]) + 10))
        out.append((k, h, len(t), sum(w in one for w in t), n, math.fsum(math.log10((one[w] + 1) / space) for w in t), score))
    return sorted(out, key=str)


def scores(docs):
    out = lm.score_texts(docs, ~lm.held_out(F.col("doc_id"))).select("doc_id", ~F.col("training"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return sorted(map(tuple, out.collect()), key=str)


def agree(got, want, share=1.0):
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert all(abs(a[5] - b[5]) <= 1e-6 + 1e-9 * abs(b[5]) for a, b in zip(got, want, strict=True))
    same = sum(abs(a[6] - b[6]) < 1e-6 for a, b in zip(got, want, strict=True))
    assert same >= share * len(want), (same, len(want))
    # Counts that are too high by chance shift scores by little on average, and by much at most in a text in a hundred: one that repeats
    # a pair thousands of times has that one chance all over.
    shift = sorted(abs(a[6] - b[6]) / (1 - b[6]) for a, b in zip(got, want, strict=True))
    assert not shift or (sum(shift) / len(shift) < 0.01 and shift[int(0.99 * (len(shift) - 1))] < 0.1), shift[-10:]


@pytest.fixture(scope="module")
def made(spark):
    random.seed(8)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(random.choices(vocabulary, [1 / (k + 1) for k in range(300)], k=random.choice([0, 1, 30])))) for i in range(400)]
    rows += [(400 + i, f"Only here {i} unseen{i} É É") for i in range(60)] + [(9, "the same row")] * 50
    return rows, spark.createDataFrame(rows, "doc_id long, text string").repartition(6).cache()


@pytest.mark.parametrize("case", ["one piece", "pieces", "rare words", "small parts"])
def test_scores(made, monkeypatch, case):
    """Also in pieces, where every word is looked up by a shuffle, and where counts are handed on and parts are many."""
    if case == "pieces":
        monkeypatch.setattr(lm, "PIECE", 20_000)
    if case == "rare words":
        monkeypatch.setattr(lm, "FREQUENT", 2)
    if case == "small parts":
        monkeypatch.setattr(lm, "PART", 64)
        monkeypatch.setattr(lm, "HELD", 50)
    monkeypatch.setattr(lm, "ENTRY", 40)  # errors become rare
    agree(scores(made[1]), plain(made[0]), 0.98)


def test_pieces_are_several(made, monkeypatch):
    rows = made[1].withColumn("training", F.lit(True))
    counts = lm.gather_counts(rows, 16)
    levels = counts.agg(F.sum("levels")).first()[0]
    assert lm.slot_groups(counts, levels) == 1
    monkeypatch.setattr(lm, "PIECE", 20_000)
    groups = lm.slot_groups(counts, levels)
    assert groups > 1 and 8 * len(lm.build_filter(counts, 16, (0, 1), groups).bits) <= 20_000 + 8 * 32
    monkeypatch.setattr(lm, "PIECE", 10)
    with pytest.raises(ValueError):
        lm.slot_groups(counts, levels)


def test_pieces_read_no_text(made, monkeypatch):
    """Texts are taken apart once: no working table holds them, and each piece reads the column of its own tokens alone."""
    tables, read, cut, piece_scores = [], [], lm.cut, lm._piece_scores
    monkeypatch.setattr(lm, "PIECE", 20_000)
    monkeypatch.setattr(lm, "cut", lambda df, *name: tables.append(df.columns) or cut(df, *name))
    monkeypatch.setattr(lm, "_piece_scores", lambda *a: read.append((out := piece_scores(*a))._jdf.queryExecution().optimizedPlan().toString()) or out)
    assert len(scores(made[1])) == len(made[0])
    assert not [t for t in tables if "text" in t]
    assert len(read) >= 4 and not [r for r in read if "text" in r]


@pytest.mark.parametrize("held", [7, 1 << 20])
def test_cells_have_each_token_once(monkeypatch, held):
    monkeypatch.setattr(lm, "HELD", held)
    texts = [lm.word_ids(t) for t in ("", "a b a b a", "c", "The the A " * 20, "é")]
    ids, row = np.concatenate(texts), np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    got = Counter()
    for dealt in lm.cells(ids, row, 4):
        for piece, cell in enumerate(dealt):
            if cell:
                words, first, own, rows = lm.read_cell(cell)
                assert (lm.group_of(words[first], 4) * 4 + lm.group_of(words[own], 4) == piece).all()
                got.update(zip(rows.tolist(), words[first].tolist(), words[own].tolist(), strict=True))
    assert got == Counter(zip(row.tolist(), lm.before(ids).tolist(), ids.tolist(), strict=True))


def test_filter_is_never_too_low():
    """Levels of keys that are there are right or, by chance, too high; one absent key in thirty at most seems to be there."""
    rng = np.random.default_rng(9)
    keys = np.unique(rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    levels = rng.integers(1, 6, len(keys))
    size = -(-int(levels.sum()) * lm.ENTRY // 8)
    bits = np.zeros(8 * size, dtype=bool)
    for level in range(1, 6):
        for k in range(lm.HASHES):
            bits[lm.place(lm.entries(keys[levels >= level], level), k, np.uint64(8 * size))] = True
    filled = lm.Filter(1, np.array([0, size, size]), bytearray(np.packbits(bits, bitorder="little")))
    got = filled.levels(keys, lm.WORDS)
    assert (got >= levels).all() and (got == levels).mean() > 0.95
    other = rng.integers(0, 2**64, 20_000, dtype=np.uint64)
    assert (filled.levels(other, lm.WORDS) > 0).mean() < 0.03
    assert (filled.levels(other, lm.PAIRS) == 0).all()


def test_scores_of_documents(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(map(tuple, QUERIES["op12_lm"](spark, SF).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score").collect()), key=str)
    agree(got, plain(rows), 0.0)
    # Texts that it has not seen are likelier than by single words, and less likely with their words in another order.
    held = [r for r in got if r[1] and r[2] > 30]
    assert sum(r[6] for r in held) > sum(r[5] for r in held)
    random.seed(10)
    text = dict(rows)
    turned = [(10**9 + r[0], " ".join(random.sample(text[r[0]].split(), r[2] - 1))) for r in held]
    mixed = spark.createDataFrame([(*r, True) for r in rows if not dict((g[0], g[1]) for g in got)[r[0]]] + [(*r, False) for r in turned + [(r[0], text[r[0]]) for r in held]], "doc_id long, text string, training boolean")
    after = {r["doc_id"]: r["score"] for r in lm.score_texts(mixed, F.col("training")).collect()}
    assert sum(after[r[0]] > after[10**9 + r[0]] for r in held) > 0.95 * len(held)


def test_score_edges(spark, edge_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    agree(scores(edge_docs), plain(rows), 0.0)
    assert scores(edge_docs.limit(0)) == []
    none = lm.score_texts(edge_docs, F.lit(None).cast("boolean")).collect()
    assert len(none) == len(rows) and all(r["n_known"] == 0 == r["train_tokens"] and r["base_score"] == 0 == r["score"] for r in none)
