"""Groups of equal texts stay whole where a shard can hold them."""

import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from sparkloom.llm import sharding
from sparkloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_groups_that_fit_a_shard_stay_whole(spark):
    copies = [700, 400, 300, 300, 200, 120, 90, 90, 70, 50, 20]  # a shard holds 1000 rows
    data = [f"copied text number {g} " + "word " * (g % 4) for g, n in enumerate(copies) for _ in range(n)]
    data += [f"text {i} " + "word " * (i % 40) for i in range(8000 - len(data))]
    df = spark.createDataFrame(list(enumerate(data)), "doc_id long, text string")
    out = sharding.assign_shards(df).select("doc_id", "text", "size", "tokens", "shard", "slot").collect()
    assert sorted(r["doc_id"] for r in out) == list(range(8000))
    groups = defaultdict(set)
    for r in out:
        groups[r["text"]].add(r["shard"])
    assert all(len(g) == 1 for g in groups.values())
    for what in ("size", "tokens"):
        sums = Counter()
        for r in out:
            sums[r["shard"]] += r[what]
        assert len(sums) == 8 and max(sums.values()) < 1.05 * min(sums.values()), (what, sums)


def test_only_a_group_that_fits_no_shard_is_parted(spark):
    text = F.when(F.col("id") % 4 == 0, F.lit("the large text")).when(F.col("id") % 10 == 1, F.lit("another text"))
    df = spark.range(8000).select(F.col("id").alias("doc_id"), F.coalesce(text, F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    shards = {r["text"]: r["n"] for r in sharding.assign_shards(df).groupBy("text").agg(F.countDistinct("shard").alias("n")).collect()}
    assert shards.pop("the large text") > 1 and set(shards.values()) == {1}


def test_query_columns_by_brute_force(spark):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    out = QUERIES["op4_shards"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    shards, whole = defaultdict(list), defaultdict(set)
    for r in out:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(data) + 1, zlib.crc32(data), "bytes", None)
        shards[r["shard"]].append(r)
        whole[texts[r["doc_id"]]].add(r["shard"])
    assert sorted(shards) == list(range(8))
    assert all(sorted(r["slot"] for r in rows) == list(range(len(rows))) for rows in shards.values())
    sizes = [sum(r["size"] for r in rows) for rows in shards.values()]
    assert max(sizes) < 1.02 * min(sizes)
    assert all(len(s) == 1 for s in whole.values())  # no group here is larger than a shard


def test_report_agrees_with_the_rows(spark, edge_docs):
    rows = sharding.assign_shards(edge_docs)
    assert rows.columns == [*edge_docs.drop(*sharding.ADDED).columns, "size", "tokens", "shard", "slot"]
    names = ("doc_id", "size", "shard", "slot")
    assert sorted(map(str, rows.select(*names).collect())) == sorted(map(str, sharding.shard_report(edge_docs).select(*names).collect()))
    assert sharding.shard_report(edge_docs.limit(0)).count() == 0
