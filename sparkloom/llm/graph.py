"""Connected components of links between documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, join_counted, remove


def connect(links: DataFrame) -> DataFrame:
    """node, root: the smallest node of each node's component, for nodes that have a link and aren't their own root.

    Large stars and small stars in turn: each node's neighbours are linked to the smallest of them, until nothing
    changes. Each round is a few joins of the links with themselves, and is cut; rows of a node with very many links
    are not gathered in one task. A link with a null end, of a node to itself or repeated adds nothing; no links give no rows; columns
    other than a and b are left out.
    """
    spark = links.sparkSession
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = F.struct(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    before = edges.agg(mark).first()[0]
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = join_counted(both.filter("v > u"), least, "u", "n", 2 * before["n"])
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        # large has at most one row for each edge.
        stars = join_counted(large, least, "u", "n", before["n"]).filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, edges = edges, cut(stars.union(least.select("u", F.col("m").alias("v"))).distinct(), rows=before["n"])
        remove(spark, last)
        now = edges.agg(mark).first()[0]
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
