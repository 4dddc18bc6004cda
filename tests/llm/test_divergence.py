"""The audit of sources against sums over all kept terms and pairs."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sparkloom.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")


def plain(rows, least, top):
    """Rows (lang, source, text): every group by every kept term, every pair of groups."""
    n, df, langs = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, text in ((a or "", b or "", c or "") for a, b, c in rows):
        own = [t.translate({c: c + 32 for c in range(65, 91)}) for t in TERM.findall(text)]
        n[lang, source].update(own)
        df[lang].update(set(own))
        langs[lang].add(source)
    out = []
    for lang, sources in langs.items():
        kept = sorted(t for t, k in df[lang].items() if k >= least)
        p, whole = {}, Counter()
        for s in sources:
            whole.update({t: n[lang, s][t] for t in kept})
            total = sum(n[lang, s][t] for t in kept) + 5 * len(kept)
            p[s] = {t: 1 + 10**9 * (n[lang, s][t] + 5) // total for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 5) // (whole.total() + 5 * len(kept)) for t in kept}
        for s in sources:
            pairs = sorted((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s)
            terms = sorted((q[t] - p[s][t], t.encode(), t) for t in kept if n[lang, s][t] and p[s][t] > q[t])
            for part, found in (("pair", pairs), ("term", terms[:top])):
                out += [(lang, s, part, item, -v, i) for i, (v, _, item) in enumerate(found, 1)]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in divergence.audit_sources(df, **options).select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("held", [1 << 19, 7])
def test_pairs_and_terms(spark, monkeypatch, held):
    """One source has a third of all rows, counts tie, some terms are in one source and some in all; small bounds hand on often."""
    monkeypatch.setattr(divergence, "HELD", held)
    monkeypatch.setattr(divergence, "PAIRS", held)
    random.seed(5)
    vocabulary = [f"{a}{b}" for a in "abcdéß語" for b in "xyzXYÉ"]
    rows = []
    for i in range(600):
        source = "hot" if i % 3 == 0 else random.choice(["a", "b", "B", "é", None, "", "z"])
        lang = random.choice(["en", "en", "de", None])
        weight = [1 + (len(source or "") * 7 + k) % 5 for k in range(len(vocabulary))]
        rows.append((lang, source, "9 ".join(random.choices(vocabulary, weight, k=random.choice([0, 1, 12])))))
    rows += [("fr", "alone", "un deux"), ("fr", "other", None), ("it", "alone", "uno " * 9)] + [("nl", "x", "een")] * 12
    df = spark.createDataFrame(rows, "lang string, source string, text string").repartition(5)
    for least, top in ((8, 5), (1, 50), (10_000, 3)):
        assert got(df, least=least, top=top) == plain(rows, least, top)


def test_audit_edges(spark, edge_docs):
    rows = [tuple(r) for r in edge_docs.select("lang", "source", "text").collect()]
    assert got(edge_docs, least=1) == plain(rows, 1, 50) and got(edge_docs) == plain(rows, 30, 50)
    assert got(edge_docs.limit(0)) == []
    assert got(edge_docs.filter("text is null"), least=1) == plain([r for r in rows if r[2] is None], 1, 50)


def test_probabilities_of_large_counts_are_exact(spark):
    n, total = 8 * 10**15 + 7, 9 * 10**15 + 1
    df = spark.createDataFrame([(n, total)], "n long, total long")
    assert df.select(divergence.probability(F.col("n"), F.col("total"))).first()[0] == 1 + 10**9 * (n + 5) // total
