"""Near copies of the pipeline against every pair's exact similarity."""

import itertools
import random
import re

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import simhash
from sparkloom.llm import similar as exact

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_set(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(x, y):
    common = len(x & y)
    return 5 * common >= 4 * (len(x) + len(y) - common)


def plain_roots(rows):
    """The smallest doc_id of each one's component, of rows (doc_id, text) with a similarity of 0.8 or more."""
    sets = {k: plain_set(t) for k, t in rows}
    up = {k: k for k in sets}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in itertools.combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y)) and similar(x, y):
            p, q = sorted((find(a), find(b)))
            up[q] = p
    return {k: find(k) for k in sets}


def kept(df):
    docs = df.withColumns({c: F.lit(None).cast("string") for c in ("lang", "source")}).withColumn("n_chars", F.length("text").cast("long"))
    return {r["doc_id"] for r in corpus_pipeline.near_duplicates(df.sparkSession, docs, SF).collect()}


def edited(words, changes, vocabulary):
    words = list(words)
    for i in random.sample(range(len(words)), changes):
        words[i] = random.choice(vocabulary)
    return words


@pytest.mark.parametrize("hot", [False, True])
def test_near_copies_about_the_bound(spark, monkeypatch, hot):
    if hot:  # keys and values are frequent early, and groups are many
        monkeypatch.setattr("sparkloom.llm.common.HOT", 4)
        monkeypatch.setattr(exact, "PAIRS", 3)
        monkeypatch.setattr(simhash, "GATHERED", 16)
        monkeypatch.setattr(simhash, "RARE", 2)
        monkeypatch.setattr(simhash, "FREQUENT", 200)
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(3000)]
    data = []
    for _ in range(60):
        base = random.choices(vocabulary, k=random.choice([12, 60, 300]))
        data.append(base)
        for _ in range(random.choice([1, 1, 6])):  # similarities of about 0.7 to 0.95
            data.append(edited(base, max(1, round(len(base) * random.uniform(0.005, 0.035))), vocabulary))
    passage = random.choices(vocabulary, k=40)
    data += [random.choices(vocabulary, k=80) + passage for _ in range(30)]
    base = random.choices(vocabulary, k=200)
    data += [edited(base, 1, vocabulary) for _ in range(40)]
    random.shuffle(data)
    rows = [(i, " ".join(w)) for i, w in enumerate(data)]
    left, want = kept(spark.createDataFrame(rows, "doc_id long, text string")), set(plain_roots(rows).values())
    assert want <= left and len(left - want) <= 0.03 * (len(rows) - len(want))


def test_recall_by_similarity(spark):
    """Of pairs of a similarity from 0.8 to 0.85 over nine tenths are found, of those above all but a few, and none below 0.8."""
    random.seed(11)
    vocabulary = [f"w{i}" for i in range(5000)]
    rows, near = [], {}
    for k in range(1500):
        base = random.choices(vocabulary, k=200)
        copy = edited(base, random.randint(1, 6), vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
        x, y = plain_set(rows[-2][1]), plain_set(rows[-1][1])
        near[2 * k + 1] = len(x & y) / len(x | y)
    left = kept(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {}
    for lo, hi in ((0.0, 0.8), (0.8, 0.85), (0.85, 0.9), (0.9, 1.0)):
        of = [k for k, s in near.items() if lo <= s < hi]
        found[lo] = sum(k not in left for k in of) / len(of)
    print(found)
    assert found[0.0] == 0 and found[0.8] >= 0.95 and found[0.85] >= 0.99 and found[0.9] >= 0.995


def test_near_copies_in_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    left, want = kept(docs), set(plain_roots([tuple(r) for r in docs.collect()]).values())
    assert want <= left and len(left - want) <= 1


def test_many_close_fingerprints_are_joined(spark, monkeypatch):
    """A large family of distinct texts whose segments have few values gives few links, and no link is lost."""
    monkeypatch.setattr(simhash, "RARE", 8)
    random.seed(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = random.choices(vocabulary, k=400)
    rows = [(i, " ".join(edited(base, 1, vocabulary))) for i in range(600)]
    rows += [(i, " ".join(random.choices(vocabulary, k=50))) for i in range(600, 900)]
    assert kept(spark.createDataFrame(rows, "doc_id long, text string")) == {0, *range(600, 900)}


def test_near_copy_edges(spark, edge_docs):
    got = simhash.drop_near_copies(edge_docs)
    assert got.columns == edge_docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in got.collect()) == [(False, i) for i in (1, 2, 4, 7, 8)] + [(True, 0)]
    assert simhash.drop_near_copies(edge_docs.limit(0)).count() == 0
