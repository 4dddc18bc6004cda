"""The exact check of near-duplicates: Jaccard similarity of the whole shingle sets of what fingerprints have linked."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, join_counted
from sparkloom.llm.shingle import shingles

#: The least similarity, as a fraction.
TOP, BOTTOM = 4, 5
#: Bytes of a set's key.
KEY = 16
#: Pairs of one set that a task compares, on average.
PAIRS = 1024


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct shingles of a text, as sorted 64-bit hashes."""
    return np.unique(shingles(text, width))


def set_key(shingle: np.ndarray) -> bytes:
    return hashlib.blake2b(shingle.tobytes(), digest_size=KEY).digest()


def are_similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets have a Jaccard similarity of TOP / BOTTOM or more; two empty ones have."""
    if BOTTOM * min(len(a), len(b)) < TOP * max(len(a), len(b)):
        return False
    common = len(np.intersect1d(a, b, assume_unique=True))
    return BOTTOM * common >= TOP * (len(a) + len(b) - common)


def with_texts(pairs: DataFrame, nodes: DataFrame, total: int) -> DataFrame:
    """pairs (a table) with text_a and text_b. The pairs of an a are dealt in parts of about PAIRS, each with a copy of its text."""
    of_a, of_b = (nodes.select(F.col("key").alias(s), F.col("text").alias(f"text_{s}")) for s in "ab")
    per = cut(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PAIRS)), rows=total)
    dealt = join_counted(pairs, per, "a", "n", total).select("a", "b", F.pmod(F.xxhash64("b"), F.col("parts")).alias("part"))
    copies = of_a.join(per, "a").select("a", "text_a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    return dealt.join(of_b, "b").join(copies, ["a", "part"])


def confirmed(pairs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """The pairs (a table of a, b: distinct keys of nodes, which has key and text) whose shingle sets are similar."""

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = lru_cache(maxsize=64)(lambda t: shingle_set(t, width))  # pairs of an a come together
        for batch in batches:
            near = [are_similar(of(x.as_py()), of(y.as_py())) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    met = with_texts(pairs, nodes, pairs.count()).select("a", "b", "text_a", "text_b")
    return cut(met.mapInArrow(similar, "a binary, b binary"))
