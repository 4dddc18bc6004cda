"""Exact top-k search by distributed histogram selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut

#: Queries that are searched together, candidates scored at once, and bins of a histogram.
QUERIES, CHUNK, BINS = 4096, 1024, 256
LIMIT = 2**63 - 1


def whole_numbers(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id, v: floor(scale * x) of each component, for the vectors that take part."""
    x = F.transform("embedding", lambda c: F.lit(float(scale)) * c.cast("double"))
    sound = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return vectors.filter(sound).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda c: F.floor(c)).alias("v"))


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    """Rows of integers; a shorter vector ends in zeros, a longer one counts so far as a query goes."""
    flat, at = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(np.diff(lists.offsets.to_numpy()))])
    if len(lists) and (np.diff(at) == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), dtype=np.int64)
    for i in range(len(lists)):
        part = flat[at[i] : at[i + 1]][:width]
        out[i, : len(part)] = part
    return out


def _scores(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products, exact: by floats while every sum is under 2^53, else by Python's integers, held to 64 bits."""
    bound = float(np.abs(queries.astype(float)).max(initial=0)) * float(np.abs(rows.astype(float)).max(initial=0)) * max(1, queries.shape[1])
    if bound < 2**53:
        return (queries.astype(np.float64) @ rows.astype(np.float64).T).astype(np.int64)
    exact = queries.astype(object) @ rows.astype(object).T
    return np.clip(exact, -LIMIT, LIMIT).astype(np.int64)


def _scored(batches: Iterator[pa.RecordBatch], ids: np.ndarray, queries: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Candidate ids, scores (queries by candidates) and which of them count: all but the query's own row."""
    for batch in batches:
        for at in range(0, batch.num_rows, CHUNK):
            part = batch.slice(at, CHUNK)
            own = part.column(0).to_numpy()
            yield own, _scores(queries, _matrix(part.column(1), queries.shape[1])), own[None, :] != ids[:, None]


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query with all other rows.

    Components are floor(scale * x). Ties go to the smaller vec_id; a query with fewer candidates returns all.
    Vectors that are null or hold a null or non-finite component take no part, nor do rows
    without an id. Rows that repeat a vec_id are candidates each; as a query that id counts once, with its
    smallest vector. Vectors of other lengths meet so far as both go. An empty table gives an empty result.

    Queries are searched in blocks of QUERIES (the only thing broadcast, of that bounded size). The integers are written
    once; for a block, all candidates are scored where they lie, several times: each pass adds up, over all tasks, a histogram of
    BINS bins of the range that still holds a query's kth value; when bins are one score wide
    the value is known, and a last pass keeps what is above it, and of its ties the k smallest ids.
    """
    rows = cut(whole_numbers(vectors, scale))
    queries = cut(rows.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    n = queries.count()
    found = None
    blocks = -(-n // QUERIES)
    for block in _blocks(queries, blocks):
        part = _search(rows, block, k) if blocks == 1 else cut(_search(rows, block, k))
        found = part if found is None else found.unionByName(part)
    empty = vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return empty if found is None else found


def _blocks(queries: DataFrame, blocks: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of at most QUERIES queries at a time, by ranges of ids."""
    rest = queries
    for _ in range(blocks):
        some = rest.orderBy("vec_id").limit(QUERIES).collect()
        ids = np.array([r["vec_id"] for r in some], dtype=np.int64)
        width = max(len(r["v"]) for r in some)
        matrix = np.zeros((len(some), width), dtype=np.int64)
        for i, r in enumerate(some):
            matrix[i, : len(r["v"])] = r["v"]
        yield ids, matrix
        rest = queries.filter(F.col("vec_id") > int(ids[-1]))


def _search(rows: DataFrame, block: tuple[np.ndarray, np.ndarray], k: int) -> DataFrame:
    context = rows.sparkSession.sparkContext
    sent = context.broadcast(block)
    n = len(block[0])

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        low, high, count = np.full(n, LIMIT), np.full(n, -LIMIT), np.zeros(n, dtype=np.int64)
        for _, scores, counts in _scored(batches, ids, queries):
            low = np.minimum(low, np.where(counts, scores, LIMIT).min(axis=1))
            high = np.maximum(high, np.where(counts, scores, -LIMIT).max(axis=1))
            count += counts.sum(axis=1)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (np.arange(n), low, high, count)], names=["q", "low", "high", "n"])

    ranges = rows.mapInArrow(spans, "q long, low long, high long, n long").groupBy("q").agg(F.min("low"), F.max("high"), F.sum("n")).collect()
    low, high, need = np.zeros(n, dtype=object), np.zeros(n, dtype=object), np.zeros(n, dtype=np.int64)
    for r in ranges:
        low[r[0]], high[r[0]], need[r[0]] = r[1], r[2], min(k, r[3])
    # The kth value is in [low, low + BINS * width); need of the values there are wanted, from the highest.
    width = np.array([max(1, -(-(int(b) - int(a) + 1) // BINS)) for a, b in zip(low, high, strict=True)], dtype=object)
    low, last = low.astype(np.int64), high.astype(np.int64)
    asked = need > 0
    while True:
        wide = np.minimum(width, LIMIT).astype(np.int64)
        state = context.broadcast((low.copy(), last.copy(), wide))

        def histograms(batches: Iterator[pa.RecordBatch], state=state) -> Iterator[pa.RecordBatch]:
            ids, queries = sent.value
            low, last, wide = state.value
            bins = np.zeros((n, BINS + 1), dtype=np.int64)  # the last for what is above the range
            for _, scores, counts in _scored(batches, ids, queries):
                inside = counts & (scores >= low[:, None])
                at = np.minimum((scores - low[:, None]).astype(np.uint64) // wide[:, None].astype(np.uint64), BINS).astype(np.int64)
                at[scores > last[:, None]] = BINS
                q, c = np.nonzero(inside)
                bins += np.bincount(q * (BINS + 1) + at[q, c], minlength=n * (BINS + 1)).reshape(n, BINS + 1)
            # A task's own kth value is at most the global one: bins below its bin can't hold that.
            above = np.cumsum(bins[:, ::-1], axis=1)[:, ::-1] - bins
            q, b = np.nonzero((bins[:, :BINS] > 0) & (above[:, :BINS] < k))
            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(b), pa.array(bins[q, b])], names=["q", "bin", "n"])

        summed = rows.mapInArrow(histograms, "q long, bin long, n long").groupBy("q", "bin").agg(F.sum("n").alias("n"))
        order = Window.partitionBy("q").orderBy(F.desc("bin"))
        wanted = rows.sparkSession.createDataFrame([(int(i), int(need[i])) for i in np.flatnonzero(asked)], "q long, need long")
        total = summed.withColumn("before", F.sum("n").over(order) - F.col("n")).join(F.broadcast(wanted), "q")
        for r in total.filter("before < need and before + n >= need").collect():
            q = r["q"]
            low[q] = int(low[q]) + r["bin"] * int(wide[q])
            last[q] = min(int(last[q]), int(low[q]) + int(wide[q]) - 1)
            need[q] -= r["before"]
        if (wide == 1).all():
            break
        width = np.array([max(1, -(-int(w) // BINS)) for w in wide], dtype=object)
    kth = context.broadcast((low, asked))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = sent.value
        value, asked = kth.value
        kept: list[list] = [[] for _ in range(n)]
        for own, scores, counts in _scored(batches, ids, queries):
            for q, c in zip(*np.nonzero(counts & asked[:, None] & (scores >= value[:, None])), strict=True):
                kept[q].append((-int(scores[q, c]), int(own[c])))
                if len(kept[q]) > 8 * k:
                    kept[q] = sorted(kept[q])[:k]
        out = [(int(ids[q]), v, -s) for q in range(n) for s, v in sorted(kept[q])[:k]]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["query_id", "vec_id", "score"])

    last = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    picked = rows.mapInArrow(pick, "query_id long, vec_id long, score long").withColumn("rank", F.row_number().over(last))
    return picked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


#: The same in SQL.
TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
