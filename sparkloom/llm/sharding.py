"""Sharding by vector bin packing."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, words

#: Groups that one task packs together, and rows that are numbered together, on average.
CELL, NUMBERED = 20_000, 5_000
ADDED = ("size", "tokens", "shard", "slot")


def pack(demand: np.ndarray, shards: int, first: int = 0, left: np.ndarray | None = None, weights: tuple[float, ...] = (1, 1, 1)) -> np.ndarray:
    """A shard for each row of demand (items by resources).

    Every shard has an equal share of each resource, or that in left (shards by resources). Items go in the order given, each to the shard with the
    highest dot product of its demand and what the shard has left, by weights; ties go round from shard first.
    """
    scale = np.maximum(demand.sum(axis=0), 1)
    demand = demand / scale
    left = np.full((shards, demand.shape[1]), 1.0 / shards) if left is None else left.copy()
    turn = (np.arange(shards) + first) % shards
    out = np.empty(len(demand), dtype=np.int32)
    for i, item in enumerate(demand):
        shard = turn[np.argmax(left[turn] @ (item * weights))]
        out[i] = shard
        left[shard] -= item
    return out


def place_whole(demand: np.ndarray, left: np.ndarray) -> np.ndarray:
    """A shard for each row of demand in the order given, or -1 where none has that much left; left is reduced.

    Of the shards that an item fits, it goes to the one with the highest dot product, as in pack.
    """
    out = np.full(len(demand), -1, dtype=np.int32)
    for i, item in enumerate(demand):
        fits = np.flatnonzero((left >= item - 1e-9).all(axis=1))
        if len(fits):
            out[i] = fits[np.argmax(left[fits] @ item)]
            left[out[i]] -= item
    return out


def assign_shards(docs: DataFrame, shards: int = 8, pieces: int = 64) -> DataFrame:
    """docs with size (UTF-8 bytes of the text and 1), tokens (words), shard and slot (from 0 in each shard).

    Equal texts are one group and share a shard. Groups of over 1 / pieces of a shard in bytes, tokens or rows are placed
    first, over the whole table and largest first, each whole where a shard has that much left of all three. Only a
    group that fits no shard is dealt, by a hash of doc_id, into parts of about 1 / pieces of a shard, each
    placed on its own. Placement balances bytes, tokens and rows jointly: the other groups
    are dealt by hash into cells of about CELL groups, and each cell is packed into what all shards have left by
    itself, largest first, so that every shard has its share of every cell. Null texts are a group of
    their own with no bytes; rows that agree in text and doc_id are never parted; an empty
    table gives an empty result; columns of the input named like an added one are replaced.
    """
    rows = measured(docs.drop(*ADDED))
    return _assigned(rows, cut(rows.select("_key", "_deal", "size", "tokens")), shards, pieces).drop("_key", "_deal")


def shard_report(docs: DataFrame, shards: int = 8, pieces: int = 64) -> DataFrame:
    """doc_id, size, text_crc32 (unsigned, of the UTF-8 text), shard and slot of every row, as by assign_shards; no text is shuffled."""
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32")
    rows = cut(measured(docs.select("doc_id", "text")).select("doc_id", "size", "tokens", crc, "_key", "_deal"))
    return _assigned(rows, rows.select("_key", "_deal", "size", "tokens"), shards, pieces).select("doc_id", "size", "text_crc32", "shard", "slot")


def measured(docs: DataFrame) -> DataFrame:
    """docs with size and tokens, _key (of the text) and _deal (of the id)."""
    text = F.col("text")
    added = {
        "size": F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1,
        "tokens": words(text),
        "_key": F.coalesce(F.unhex(F.md5(text)), F.lit(b"")),
        "_deal": F.xxhash64("doc_id"),
    }
    return docs.withColumns(added)


def _assigned(rows: DataFrame, narrow: DataFrame, shards: int, pieces: int) -> DataFrame:
    """rows, as by measured, with shard and slot; narrow has their working columns and is a table."""
    demand = [F.sum("size").alias("size"), F.sum("tokens").alias("tokens"), F.count("*").alias("rows")]
    totals = narrow.agg(*demand).first()
    groups = narrow.groupBy("_key").agg(*demand)
    share = [F.col(c) * (shards * pieces) / F.lit(max(1, totals[c] or 0)) for c in ("size", "tokens", "rows")]
    # Each is over 1 / (shards * pieces) of a total: no more than 3 * shards * pieces groups can be.
    shared = groups.withColumn("_share", F.greatest(*share))
    is_large = (F.col("_share") > 1) & (F.col("rows") > 1)
    large = shared.filter(is_large).orderBy(F.desc("_share"), "_key").collect()
    names = ("size", "tokens", "rows")
    scale = np.array([max(1, totals[c] or 0) for c in names], dtype=np.float64)
    left = np.full((shards, 3), 1.0 / shards)
    whole = place_whole(np.array([[r[c] for c in names] for r in large], dtype=np.float64).reshape(-1, 3) / scale, left)
    fixed = [(bytes(r["_key"]), 0, int(s)) for r, s in zip(large, whole, strict=True) if s >= 0]
    split = [(bytes(r["_key"]), math.ceil(r["_share"])) for r, s in zip(large, whole, strict=True) if s < 0]
    spark = rows.sparkSession
    ways = F.broadcast(spark.createDataFrame([(k, 1) for k, _, _ in fixed] + split, "_key binary, _parts int"))

    def parted(df: DataFrame) -> DataFrame:
        """The rows of large groups, with their parts."""
        return df.join(ways, "_key").withColumn("_part", F.pmod("_deal", "_parts")).drop("_parts")

    if split:
        parts = parted(narrow).join(F.broadcast(spark.createDataFrame(split, "_key binary, _n int")), "_key", "left_semi")
        parts = parts.groupBy("_key", "_part").agg(*demand).collect()
        d = np.array([[r[c] for c in names] for r in parts], dtype=np.float64) / scale
        order = sorted(range(len(parts)), key=lambda i: (-d[i].max(), bytes(parts[i]["_key"]), parts[i]["_part"]))
        # pack takes shares of what it is given.
        own = np.maximum(d.sum(axis=0), 1e-12)
        for i, shard in zip(order, pack(d[order] * scale, shards, left=left / own), strict=True):
            fixed.append((bytes(parts[i]["_key"]), int(parts[i]["_part"]), int(shard)))
            left[shard] -= d[i]
    placed_large = F.broadcast(spark.createDataFrame(fixed, "_key binary, _part long, shard int"))

    items = cut(shared.filter(~is_large).select("_key", *names))
    cells = -(-items.count() // CELL) or 1
    left = left / np.maximum(left.sum(axis=0), 1e-12)
    # Many rows of short texts may leave a shard bytes that no rows can fill: bytes and tokens go before rows then.
    weights = (1, 1, 1 / 32) if fixed else (1, 1, 1)

    def pack_cell(pdf: pd.DataFrame) -> pd.DataFrame:
        d = pdf[["size", "tokens", "rows"]].to_numpy(dtype=np.float64)
        largest = (d / np.maximum(d.sum(axis=0), 1)).max(axis=1)
        pdf = pdf.assign(_largest=largest).sort_values(["_largest", "_key"], ascending=[False, True])
        d = pdf[["size", "tokens", "rows"]].to_numpy(dtype=np.float64)
        return pdf[["_key"]].assign(shard=pack(d, shards, int(pdf["_cell"].iloc[0]), left, weights))

    placed = items.withColumn("_cell", F.pmod(F.xxhash64("_key"), F.lit(cells))).groupBy("_cell").applyInPandas(pack_cell, "_key binary, shard int")
    placed = cut(placed)

    def with_shard(df: DataFrame) -> DataFrame:
        """df with shard; rows of large groups stay where they are."""
        return parted(df).join(placed_large, ["_key", "_part"]).drop("_part").unionByName(df.join(ways, "_key", "left_anti").join(placed, "_key"))

    out = with_shard(rows)
    # Slots: numbers within small buckets of a shard, after those of the buckets before.
    buckets = -(-(totals["rows"] or 0) // NUMBERED) or 1
    bucket = F.pmod(F.xxhash64("_key", "_deal"), F.lit(buckets)).alias("_bucket")
    counts = with_shard(narrow).groupBy("shard", bucket).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_n")
    offsets = counts.select("shard", "_bucket", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("shard", "_bucket").orderBy("doc_id", "_key"))
    out = out.withColumn("_bucket", bucket).join(offsets, ["shard", "_bucket"]).withColumn("slot", F.col("_before") + number - 1)
    return out.select(*rows.columns, "shard", "slot")
