"""What the operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: A key is frequent if it has over 1 / HOT of all rows: there are fewer than HOT of those.
HOT = 1024
#: Bits, at most, of a filter of keys, and bytes of the parts in which it is put together.
BITS, SEGMENT = 1 << 25, 1 << 13
#: Rows of ids, links or fingerprints that a task writes, on average; tables of fewer get SPREAD tasks a core.
WRITTEN, SPREAD = 1 << 13, 2
#: Paths of the working tables made so far, so that who has written a result can remove what led to it.
MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_folder(spark: SparkSession) -> None:
    """See that there is a shared checkpoint folder.

    It is the session's spark.checkpoint.dir; only where a local session has none, as in tests, is a
    temporary one set.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="sparkloom-")
        context.setCheckpointDir(folder)


def cut(df: DataFrame, name: str = "cut", rows: int | None = None) -> DataFrame:
    """Write df as a table in the shared checkpoint folder and go on from there.

    Unlike a checkpoint it is planned by its own size: a checkpoint keeps the estimate of the plan before it, and estimates of joins
    multiply, in a loop without end.

    rows: about as many as the last step of df reads at most, where that is known. Its tasks are put together so that their number follows that and not
    the number of shuffle partitions: each task writes a file, and on a local disk each file starts processes, which cost more than a few rows do.
    """
    path = shared_folder(df.sparkSession, name)
    if rows is not None:
        df = df.coalesce(max(SPREAD * df.sparkSession.sparkContext.defaultParallelism, -(-rows // WRITTEN)))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_counted(rows: DataFrame, per: DataFrame, key: str, count: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows and per, which has one row a key and, in count, at least the rows that have it.

    total is at least the sum of count, so fewer than HOT keys have over 1 / HOT of it. Their rows are dealt in parts of about
    that size, each with a copy of the key's row; only the frequent keys themselves are broadcast. A null key has no match.
    """
    parts = F.ceil(F.col(count) * HOT / max(1, total)).cast("long")
    hot = F.broadcast(per.filter(F.col(count) > F.lit(total / HOT)).select(key, parts.alias("_parts")))
    dealt = rows.join(hot, key, "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0))).drop("_parts")
    last = F.when(F.col(count) > F.lit(total / HOT), parts - 1).otherwise(F.lit(0))
    copies = per.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), last.cast("long"))))
    return dealt.join(copies, [key, "_part"], how).drop("_part")


def key_filter(keys: DataFrame) -> Callable[[list[bytes]], np.ndarray]:
    """Which of some keys may be one of keys' (a table of one column): a Bloom filter, so that whole rows with other keys need no shuffle.

    Keys are digests of 16 bytes or more. The filter has sixteen bits a key and BITS at most (4 MB, broadcast); beyond two million keys
    more rows than need be seem to be there. None that is there is missed.
    """
    bits = min(BITS, max(1 << 10, 1 << (16 * keys.count()).bit_length()))
    size = min(bits // 8, SEGMENT)

    def places(data: list[bytes]) -> np.ndarray:
        return np.frombuffer(b"".join(x[:16] for x in data), dtype="<u4").reshape(-1, 4) & np.uint32(bits - 1)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        is_set = np.zeros(bits, dtype=bool)
        for batch in batches:
            is_set[places(batch.column(0).to_pylist())] = True
        for at, part in enumerate(np.packbits(is_set, bitorder="little").reshape(-1, size)):
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([part.tobytes()], pa.binary())], names=["at", "part"])

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # all parts together are of BITS at most
        for batch in batches:
            for at, part in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held[at] = held.get(at, np.uint8(0)) | np.frombuffer(part, dtype=np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["at", "part"])

    whole = bytearray(bits // 8)
    for r in keys.mapInArrow(mark, "at long, part binary").repartition("at").mapInArrow(both, "at long, part binary").collect():
        whole[r["at"] * size : (r["at"] + 1) * size] = r["part"]
    sent = keys.sparkSession.sparkContext.broadcast(whole)

    def may_be(data: list[bytes]) -> np.ndarray:
        at = places(data)
        return ((np.frombuffer(sent.value, dtype=np.uint8)[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)

    return may_be


def may_be_in(found: Callable[[list[bytes]], np.ndarray], key: str) -> Column:
    """A key_filter as a column."""

    @F.pandas_udf("boolean")
    def test(keys: pd.Series) -> pd.Series:
        return pd.Series(found(keys.tolist()), dtype=bool)

    return test(F.col(key))


def words(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: int, doc_id: Column, text: Column) -> Column:
    """A number in [0, 1) that depends only on the seed and the row; rows without an id use their text."""
    key = F.coalesce(doc_id.cast("string"), F.concat(F.lit("~"), text), F.lit("~"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    checkpoint_folder(spark)
    MADE.append(f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}")
    return MADE[-1]


def remove_made(spark: SparkSession, since: int, but: str = "") -> None:
    """Delete the working tables made since there were so many, but one; for what is written and read no more from them."""
    for path in MADE[since:]:
        if path != but:
            remove(spark, path)
    MADE[since:] = [but] if but else []


def remove(spark: SparkSession, table_: DataFrame | str) -> None:
    """Delete a table (its path, or what cut gave) that nothing reads any more, wherever it is stored."""
    path = table_ if isinstance(table_, str) else table_.inputFiles()[0].rsplit("/", 1)[0]
    context = spark.sparkContext
    folder = context._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(context._jsc.hadoopConfiguration()).delete(folder, True)
