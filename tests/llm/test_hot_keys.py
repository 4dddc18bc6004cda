"""Keys that a large part of all rows have are dealt over tasks, whether they are found in another table or not."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from sparkloom.llm import graph, mixing, quality, secrets, simhash, similar, urls
from sparkloom.llm.common import key_filter, may_be_in, shared_folder
from sparkloom.llm.queries import RULES
from test_similar import edited, plain_roots

SF = "/root/testdata/sf0.01"


@pytest.fixture
def by_task(spark):
    """Rows of a DataFrame by task, with no broadcast of tables and no joining or splitting of partitions."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "64"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield lambda df: sorted((r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()), reverse=True)
    for k, v in before.items():
        spark.conf.set(k, v)


def test_blobs_without_findings(spark, by_task):
    """Half of the texts are null and a quarter is one text, both without secrets; an eighth is one with a secret."""
    def text(i):
        return None if i % 2 else "nothing here" if i % 4 else "token: abcdefgh12345" if i % 8 else f"secret = value{i:08}" if i % 16 else f"own {i}"

    rows = [(i, text(i)) for i in range(8000)]
    found = secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string").repartition(16), shared_folder(spark, "test-hot"))
    sizes = by_task(found)
    assert sum(sizes) == 8000 and sizes[0] <= 1500, sizes[:5]
    got = Counter(len(r["secrets"]) for r in found.collect())
    assert got == Counter(int(bool(t and ("token" in t or "secret" in t))) for _, t in rows)


def test_filter_of_blobs_loses_none(spark):
    keys = spark.range(3000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("k"))
    assert keys.filter(may_be_in(key_filter(keys.limit(1000)), "k")).count() >= 1000
    assert keys.limit(1000).filter(may_be_in(key_filter(keys.limit(1000)), "k")).count() == 1000
    assert keys.filter(may_be_in(key_filter(keys.limit(1000)), "k")).count() < 1200
    assert keys.filter(may_be_in(key_filter(keys.limit(0)), "k")).count() == 0


def test_hosts_without_a_name(spark, by_task):
    """Half of the URLs have no host, a quarter one whose name has no letters."""
    rows = [(i, None if i % 2 else "http://-/x" if i % 4 else f"http://name{i}.test/a", "<p>name</p>") for i in range(8000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(16)
    judged = urls.judge_urls(pages, RULES)
    sizes = by_task(judged)
    assert sum(sizes) == 8000 and sizes[0] <= 1500, sizes[:5]
    assert Counter(r["host"] for r in judged.collect())[""] == 4000


def test_url_edges(spark):
    """Nulls, empty and very long URLs, repeated rows, ties, an empty table, and columns that clash with added ones."""
    long = "http://" + "longname" * 2000 + ".org/" + "en/path" * 5000
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, long), (4, long), (None, "http://EXAMPLE.org/es/x"), (5, "x://a.com"), (6, "x://a.com/fr/?q#f")]
    pages = spark.createDataFrame([(*r, None if r[0] == 5 else "<b>long name</b>", "clash") for r in rows], "page_id long, url string, html string, host string")
    pages = pages.withColumns({c: F.lit("clash") for c in ("path", "rule", "verdict", "score", "words", "buckets", "_urls", "block", "word", "n")})
    got = {r["page_id"]: r for r in urls.judge_urls(pages, RULES).collect()}
    assert urls.judge_urls(pages, RULES).count() == 8
    assert [(got[k]["host"], got[k]["path"], got[k]["rule"]) for k in (1, 2, 3)] == [("", "", None)] * 3
    assert got[4]["rule"] == "org/" and got[4]["host"] == "longname" * 2000 + ".org"
    assert got[None]["rule"] == "example.org/es/" and got[None]["verdict"] == "block"
    assert (got[5]["host"], got[5]["path"], got[5]["rule"]) == ("a.com", "", None)
    assert (got[6]["rule"], got[6]["verdict"]) == ("com/fr/", "allow")
    assert urls.judge_urls(pages.limit(0), RULES).count() == 0


def test_a_frequent_source_among_many(spark, by_task, monkeypatch):
    """Where sources are too many to be broadcast, the rows of one that half of all have are dealt; the plan is the same."""
    rows = [(i, "w " * (i % 7), None if i % 2 else f"s{i % 40}") for i in range(8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(16)
    want = sorted(map(tuple, mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "copies").collect()))
    monkeypatch.setattr(mixing, "FEW", 3)
    planned = mixing.plan_mix(docs).select("doc_id", "size", "source_size", "target", "copies")
    sizes = by_task(planned)
    assert sum(sizes) == 8000 and sizes[0] <= 1500, sizes[:5]
    assert sorted(map(tuple, planned.collect())) == want


def test_labels_of_absent_documents_take_no_place(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    absent = spark.range(10**7, 10**7 + 20_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    want = {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, labels).collect()}
    assert {r["doc_id"]: r["kept"] for r in quality.judge_quality(docs, labels.unionByName(absent)).collect()} == want
    assert sum(want.values()) < sum(not r["base_failed"] for r in quality.judge_quality(docs, labels.limit(0)).collect())


def components(pairs, keys):
    up = {k: k for k in keys}

    def find(k):
        while up[k] != k:
            k = up[k]
        return k

    for a, b in pairs:
        up[find(a)] = find(b)
    return Counter(frozenset(k for k in keys if find(k) == r) for r in {find(k) for k in keys})


@pytest.mark.parametrize("splits", [1, 2])
def test_crowded_buckets(spark, monkeypatch, splits):
    """Fingerprints that share their first 22 bits, some of them near: split buckets join what all pairs join."""
    monkeypatch.setattr(simhash, "CROWD", 20)
    monkeypatch.setattr(simhash, "SPLITS", splits)
    random.seed(12)
    prints = set()
    for _ in range(150):
        base = (0x2A5A5A << 42) | random.getrandbits(42)
        prints.add(base)
        for _ in range(random.choice([0, 0, 3])):
            for bit in random.sample(range(64), random.randint(1, 5)):
                base ^= 1 << bit
            prints.add(base)
    prints = sorted(prints)
    df = spark.createDataFrame([(bytearray(p.to_bytes(8, "big")),) for p in prints], "fingerprint binary").repartition(3)
    links = [tuple(int.from_bytes(x, "big") for x in r) for r in simhash.near_links(df, 4).collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in links)
    assert components(links, prints) == components([(a, b) for a, b in itertools.combinations(prints, 2) if (a ^ b).bit_count() <= 4], prints)


def test_a_crowded_bucket_is_several_tasks(spark, by_task):
    rng = np.random.default_rng(13)
    own = np.unique(rng.integers(0, 2**42, 60_000, dtype=np.uint64)) | np.uint64(0x2A5A5A << 42)
    df = spark.createDataFrame([(0, int(x)) for x in own.astype(np.int64)], "bucket long, print long")
    out = simhash._uncrowded(df, 4, simhash.SEGMENTS, 4096).groupBy("bucket").count().agg(F.max("count"), F.sum("count")).first()
    assert out[0] <= 4096 and out[1] == 5 * len(own)


def test_a_diffuse_family_gives_few_pairs(spark, monkeypatch):
    """800 texts that are 5 edits of 200 words from a text that isn't there: few pairs are compared in full and all stay; with it, most go."""
    random.seed(14)
    vocabulary = [f"w{i}" for i in range(5000)]
    base = random.choices(vocabulary, k=200)
    rows = [(i, " ".join(edited(base, 5, vocabulary))) for i in range(800)]
    compared = []
    confirmed = similar.confirmed
    monkeypatch.setattr(simhash, "confirmed", lambda pairs, *a: (compared.append(pairs.count()), confirmed(pairs, *a))[1])
    for data, most in ((rows, 40 * len(rows)), ([*rows, (-1, " ".join(base))], 40 * len(rows))):
        compared.clear()
        left = {r["doc_id"] for r in simhash.drop_near_copies(spark.createDataFrame(data, "doc_id long, text string")).collect()}
        want = set(plain_roots(data).values())
        assert want <= left and len(left - want) <= 0.02 * len(data)
        print(len(left), compared)
        assert sum(compared) <= most


def test_the_entry_has_all_queries():
    """The entry leaves these out where they can't be imported; here they can."""
    names = set(__spark_entry__.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{i}" for i in range(1, 14)} and len(names) == 15


def test_each_is_joined_with_the_smallest():
    rng = np.random.default_rng(15)
    for _ in range(100):
        n, m = (int(x) for x in rng.integers(1, 50, 2))
        a, b = rng.integers(0, n, m), rng.integers(0, n, m)
        of = {k: min(c) for c in components(zip(a.tolist(), b.tolist(), strict=True), list(range(n))) for k in c}
        assert simhash._least_joined(a, b, n).tolist() == [of[k] for k in range(n)]


def test_connect_edges(spark):
    """Null ends, links to itself and repeated links add nothing; no links give no rows."""
    links = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (2, 3), (5, 5), (None, 7), (8, None), (9, 4)], "a long, b long")
    assert sorted(map(tuple, graph.connect(links).collect())) == [(2, 1), (3, 1), (9, 4)]
    assert graph.connect(links.limit(0)).count() == 0


def test_few_files(spark, by_task, monkeypatch):
    """Tables of links have as many files as their rows need, whatever the number of shuffle partitions; the links are joined alike."""
    written = []
    monkeypatch.setattr(graph, "remove", lambda spark, table: None)  # else the last rounds' tables are gone
    monkeypatch.setattr(graph, "cut", lambda *a, f=graph.cut, **b: (written.append(f(*a, **b)), written[-1])[1])
    links = [(i, i + 1) for i in range(0, 600, 2)] + [(1000, i) for i in range(1001, 1300)]
    found = {(r["node"], r["root"]) for r in graph.connect(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {(b, a) for a, b in links}
    files = [len(t.inputFiles()) for t in written[1:]]
    assert files and max(files) <= 2 * spark.sparkContext.defaultParallelism < 64, files
