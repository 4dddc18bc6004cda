"""Importance resampling towards a target corpus: array-scored weights, then a distributed LSD radix sort of noisy scores."""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, remove

#: Hashed features; bits of a digit of the sort, which bound a block's counters; rows of a block.
BUCKETS, DIGIT = 10_000, 11
LEAST_BLOCK, MOST_BLOCK, BLOCKS = 1 << 10, 1 << 20, 1 << 10
#: Bytes that are part of no word become a space, A-Z become a-z.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
SORTED = "doc_id long, n_features long, weight long, score long, block long, digit long, nth long"


def feature_buckets(text: str, grams: int, buckets: int) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of each run of 1 to grams consecutive words, repeats included."""
    words = text.encode().translate(WORD_BYTES).split()
    runs = [words] + [[b" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] for n in range(2, grams + 1)]
    hashed = [np.fromiter(map(crc32, r), dtype=np.uint32, count=len(r)) for r in runs]
    return len(words), np.concatenate(hashed) % np.uint32(buckets)


def with_buckets(texts: DataFrame, text: Column, grams: int, buckets: int, *keep: str) -> DataFrame:
    """keep, then n_words, n_features and packed, the buckets as little-endian unsigned 32-bit integers; a null text has none."""

    @F.pandas_udf("n_words long, n_features long, packed binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = ((n, len(at), at.astype("<u4").tobytes()) for n, at in (feature_buckets(t, grams, buckets) for t in texts))
        return pd.DataFrame(out, columns=["n_words", "n_features", "packed"])

    return texts.select(*keep, of(F.coalesce(text.cast("string"), F.lit(""))).alias("_f")).select(*keep, "_f.*")


def bucket_counts(packed: DataFrame, buckets: int) -> np.ndarray:
    """Features in each bucket over all rows: tasks add up arrays, the driver gets a row for each bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_py(), dtype="<u4"), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    out = np.zeros(buckets, dtype=np.int64)
    for r in packed.select("packed").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of how much likelier each bucket is in the target), both with one added to every bucket."""
    all_s, all_t = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratio = (target + 1).astype(float) * all_s / ((source + 1).astype(float) * all_t)
    return np.array([math.floor(1000 * math.log(x)) for x in ratio.tolist()], dtype=np.int64)


def noise(seed: int, doc_id: Column) -> Column:
    """floor(1000 * a Gumbel deviate) by the SHA-256 of seed and doc_id; rows without an id share one."""

    @F.pandas_udf("long")
    def gumbel(h: pd.Series) -> pd.Series:
        return pd.Series([math.floor(-1000 * math.log(-math.log((x + 0.5) / 4294967296))) for x in h], dtype="int64")

    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return gumbel(F.conv(F.substring(digest, 1, 8), 16, 10).cast("long"))


def scored(docs: DataFrame, target: DataFrame, grams: int = 1, buckets: int = BUCKETS, seed: int = 2024) -> DataFrame:
    """A table of doc_id, n_words, n_features, weight and score of every row of docs; each text is read once."""
    own = cut(with_buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), F.col("text"), grams, buckets, "doc_id"))
    wanted = with_buckets(target.select("text"), F.col("text"), grams, buckets)
    table = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(own, buckets), bucket_counts(wanted, buckets)))

    @F.pandas_udf("long")
    def weigh(packed: pd.Series) -> pd.Series:
        gain = table.value
        return pd.Series([int(gain[np.frombuffer(x, dtype="<u4")].sum()) for x in packed], dtype="int64")

    out = own.select("doc_id", "n_words", "n_features", weigh("packed").alias("weight"), noise(seed, F.col("doc_id")).alias("noise"))
    out = cut(out.select("doc_id", "n_words", "n_features", "weight", (F.col("weight") + F.col("noise")).alias("score")))
    remove(docs.sparkSession, own)
    return out


def _digits(rows: DataFrame) -> tuple[int, list[tuple[str, int, int]]]:
    """Number of rows, and the digits of the composite key, the least significant first: column, what it is counted from, shift.

    The key is score from the highest, then rows with an id, then doc_id from the smallest; the range that each has decides on
    its number of digits.
    """
    r = rows.agg(F.count("*").alias("n"), F.min("doc_id").alias("a"), F.max("doc_id").alias("z"), F.count("doc_id").alias("ids"), F.min("score").alias("low"), F.max("score").alias("high")).first()
    out = []
    if r["ids"]:
        out += [("doc_id", r["a"], at) for at in range(0, (r["z"] - r["a"]).bit_length(), DIGIT)]
    if 0 < r["ids"] < r["n"]:
        out.append(("none", 0, 0))
    if r["n"]:
        out += [("score", r["high"], at) for at in range(0, (r["high"] - r["low"]).bit_length(), DIGIT)]
    return r["n"], out or [("none", 0, 0)]


def _counted(rows: DataFrame, digit: tuple[str, int, int]) -> DataFrame:
    """rows, which come by blocks and in order in each, with digit and nth, a row's number among those of its block and digit."""
    column, origin, shift = digit

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, np.zeros(1 << DIGIT, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, block = batch.column(0), batch.column(4).to_numpy()
            if column == "none":
                value = ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint64)
            elif column == "doc_id":
                value = ids.fill_null(origin).to_numpy().astype(np.uint64) - np.uint64(origin % 2**64)
            else:
                value = np.uint64(origin % 2**64) - batch.column(3).to_numpy().astype(np.uint64)
            own = ((value >> np.uint64(shift)) & np.uint64((1 << DIGIT) - 1)).astype(np.int64)
            nth = np.empty(len(own), dtype=np.int64)
            edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if block[a] != current:
                    current, seen = block[a], np.zeros(1 << DIGIT, dtype=np.int64)
                some = own[a:z]
                counts = np.bincount(some, minlength=1 << DIGIT)
                order = np.argsort(some, kind="stable")
                first = np.cumsum(counts) - counts
                nth[a + order] = np.arange(z - a) - first[some[order]] + seen[some[order]]
                seen = seen + counts
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(own), pa.array(nth)], names=[c.split()[0] for c in SORTED.split(", ")])

    return rows.mapInArrow(count, SORTED)


def _starts(counted: DataFrame) -> DataFrame:
    """block, digit, start: where the first row of each block and digit goes, after all smaller digits and earlier blocks."""
    found = cut(counted.groupBy("block", "digit").agg(F.count("*").alias("n")))
    digits = found.groupBy("digit").agg(F.sum("n").alias("n"))  # 2 ** DIGIT rows at most
    before = F.coalesce(F.sum("n").over(Window.orderBy("digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("digit").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.select("block", "digit", earlier.alias("earlier")).join(F.broadcast(digits.select("digit", before.alias("before"))), "digit")
    return placed.select("block", "digit", (F.col("before") + F.col("earlier")).alias("start"))


def radix_places(rows: DataFrame) -> DataFrame:
    """rows (doc_id, n_features, weight, score: long) with place, from 0 in the order of score descending and doc_id ascending.

    An LSD radix sort: each pass counts the digits of each block of consecutive places, adds up global offsets of blocks and
    digits, and sends every row to its destination, equal digits in the order that they had. No task holds more than a block's
    counters and a batch; a frequent score or digit is dealt over the blocks it goes to. Ids that are null come last; rows that agree in both
    keep the order in which they were read.
    """
    n, digits = _digits(rows)
    size = min(MOST_BLOCK, max(LEAST_BLOCK, -(-n // BLOCKS)))
    now = rows.select("doc_id", "n_features", "weight", "score", F.spark_partition_id().cast("long").alias("block"))
    counted = last = None
    for digit in digits:
        last, counted = counted, cut(_counted(now, digit))
        if last is not None:
            remove(rows.sparkSession, last)
        place = (F.col("start") + F.col("nth")).alias("place")
        placed = counted.join(_starts(counted), ["block", "digit"]).select("doc_id", "n_features", "weight", "score", place)
        now = placed.withColumns({"block": F.expr(f"place div {size}"), "at": F.col("place")}).repartition("block").sortWithinPartitions("block", "at")
        now = now.select("doc_id", "n_features", "weight", "score", "block")
    return placed


def resample(docs: DataFrame, target: DataFrame, top: int = 10, bottom: int = 100, grams: int = 1, buckets: int = BUCKETS, seed: int = 2024, least: int = 20) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of docs; those drawn have a rank from 1, others null.

    Features are runs of 1 to grams words, hashed to buckets; a bucket's gain is how much likelier it is in target's texts than in those of docs. weight
    adds up a text's gains, score adds Gumbel noise by seed and doc_id, so that the highest scores are a draw without
    replacement in proportion to exp(weight / 1000). Of the N rows of at least `least` words, floor(top * N / bottom) are drawn, ties to the smaller doc_id (null last).

    A null or empty text has no words, weight 0 and isn't drawn if least is above 0; rows that agree in doc_id share their noise,
    and repeated rows are ranked one after the other; an empty table gives an empty result, an empty target gains of the mere
    prior; other columns of docs are left out.
    """
    rows = scored(docs, target, grams, buckets, seed)
    enough = F.col("n_words") >= least
    drawn = rows.filter(enough).count() * top // bottom
    ranked = radix_places(rows.filter(enough).drop("n_words")).withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1)).drop("place")
    return ranked.unionByName(rows.filter(~enough).drop("n_words").withColumn("rank", F.lit(None).cast("long")))


def _crc_table() -> list[int]:
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xEDB88320 if n & 1 else 0)
        out.append(n)
    return out


#: The same in SQL: CRC-32 byte by byte over the distinct words, and one sort.
RESAMPLE_SQL = rf"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), each AS MATERIALIZED (SELECT r, unnest(w) AS w FROM d
), known AS MATERIALIZED (
  SELECT w, xor(4294967295::BIGINT, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, b: xor(c >> 8, ([{", ".join(map(str, _crc_table()))}]::BIGINT[])[1 + (xor(c, b) & 255)]))) % {BUCKETS} AS b
  FROM (SELECT w FROM each UNION SELECT w FROM g)
), s AS (SELECT b, count(*) AS n FROM each JOIN known USING (w) GROUP BY b
), t AS (SELECT b, count(*) AS n FROM g JOIN known USING (w) GROUP BY b
), gain AS MATERIALIZED (
  SELECT b, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM each) + {BUCKETS})::DOUBLE / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM g) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (b)
), weighed AS (SELECT r, sum(gain)::BIGINT AS weight FROM each JOIN known USING (w) JOIN gain USING (b) GROUP BY r
), scores AS (
  SELECT d.r, doc_id, len(w)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || left(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
  FROM d LEFT JOIN weighed ON d.r = weighed.r
), ranks AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank, count(*) OVER () AS n FROM scores WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= 10 * n // 100 THEN rank END::BIGINT AS rank FROM scores LEFT JOIN ranks USING (r)
"""
