"""Resampling against plain Python, and the radix sort against a sort."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain(rows, target, grams=1, buckets=10_000, least=20, top=10, bottom=100):
    def features(text):
        w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, grams + 1) for i in range(len(w) - n + 1)]

    own, wanted = [features(t) for _, t in rows], [features(t) for t in target]
    s, t = Counter(b for _, f in own for b in f), Counter(b for _, f in wanted for b in f)
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    out = []
    for (k, _), (n, f) in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in f)
        out.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n >= least))
    ranked = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = len(ranked) * top // bottom
    return sorted([(*r[:4], i if i <= drawn else None) for i, r in enumerate(ranked, 1)] + [(*r[:4], None) for r in out if not r[4]], key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


@pytest.mark.parametrize("grams", [1, 2])
def test_draw(spark, grams):
    random.seed(6)
    vocabulary = [f"{a}{b}" for a in ("ab", "É", "x9", "Q") for b in range(60)]
    rows = [(i * 7 - 300, ", ".join(random.choices(vocabulary, k=random.choice([0, 3, 19, 20, 40])))) for i in range(500)] + [(5, "b1 " * 30)] * 40
    target = [" ".join(random.choices(vocabulary[:50], k=30)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.resample(docs, wanted, grams=grams, top=35)) == plain(rows, target, grams, top=35)


def test_draw_edges(spark, edge_docs):
    rows = [tuple(r) for r in edge_docs.select("doc_id", "text").collect()]
    target = [rows[0][1]]
    wanted = spark.createDataFrame([(t,) for t in target], "text string")
    for least in (0, 20):
        assert got(resample.resample(edge_docs, wanted, top=100, least=least)) == plain(rows, target, top=100, least=least)
    assert got(resample.resample(edge_docs, wanted.limit(0), top=50)) == plain(rows, [], top=50)
    assert got(resample.resample(edge_docs.limit(0), wanted)) == []


@pytest.mark.parametrize("kind", ["wide", "ties", "one", "extremes"])
def test_radix_places(spark, monkeypatch, kind):
    """Small blocks, so that digits and ties run over many of them; ids and scores of the whole range of 64 bits."""
    monkeypatch.setattr(resample, "LEAST_BLOCK", 16)
    random.seed(7)
    big = 2**62
    rows = {
        "wide": [(random.randrange(-big, big), 1, 2, random.randrange(-(2**40), 2**40)) for _ in range(900)],
        "ties": [(random.choice([None, 1, 2, 3, 10**6]), i % 2, 0, random.choice([-5, 7])) for i in range(900)],
        "one": [(4, 1, 1, 1)],
        "extremes": [(-(2**63), 0, 0, 2**62), (2**63 - 1, 0, 0, -(2**62)), (0, 0, 0, 0), (None, 0, 0, 0), (None, 0, 0, 2**62)],
    }[kind]
    df = spark.createDataFrame(rows, "doc_id long, n_features long, weight long, score long").repartition(3)
    out = sorted(resample.radix_places(resample.cut(df)).collect(), key=lambda r: r["place"])
    assert [r["place"] for r in out] == list(range(len(rows)))
    want = sorted(rows, key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    assert [(r["doc_id"], r["score"]) for r in out] == [(r[0], r[3]) for r in want]
    assert sorted(map(str, (tuple(r)[:4] for r in out))) == sorted(map(str, rows))


def test_gumbel_noise_is_that_of_its_row(spark):
    df = spark.createDataFrame([(1,), (1,), (2,), (None,)], "doc_id long")
    a, b, c, d = (r[0] for r in df.select(resample.noise(2024, F.col("doc_id"))).collect())
    assert a == b and len({a, c, d}) == 3
