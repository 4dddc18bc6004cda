"""Mixing sources to target weights by repetition rates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkloom.llm.common import cut, draw, join_counted, words

ADDED = ("size", "source_size", "target", "copies")
#: Sources up to this number are broadcast: some forty bytes each, and their names.
FEW = 100_000


def source_targets(docs: DataFrame, size: Column, weights: Sequence[int], cap: int) -> DataFrame:
    """One row per source: source, rows, source_size, target.

    The total size is shared by weight; a source stops at cap times its own size and the rest is
    shared again. With the sources in the order of cap * size / weight this has a closed form:
    the first source that need not stop fixes the level at which all later ones are filled.
    """
    per = docs.groupBy("source").agg(F.count("*").alias("rows"), F.sum(size).alias("source_size"))
    weight = F.array(*[F.lit(int(w)).cast("long") for w in weights])
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.select("source", "rows", "source_size", weight[F.pmod(position, F.lit(len(weights)))].alias("weight"))
    by_room = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum(cap * F.col("source_size")).over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    everything = Window.partitionBy()
    per = per.withColumns(
        {
            "left": F.sum("source_size").over(everything) - before,
            "rest": F.sum("weight").over(by_room.rowsBetween(Window.currentRow, Window.unboundedFollowing)),
        }
    )
    enough = cap * F.col("source_size") * F.col("rest") >= F.col("weight") * F.col("left")
    level = F.max_by(F.struct("left", "rest"), F.when(enough, F.col("rest"))).over(everything)
    filled = (F.col("weight") * level["left"]).cast("double") / level["rest"].cast("double")
    target = F.least((cap * F.col("source_size")).cast("double"), filled)
    return per.select("source", "rows", "source_size", target.alias("target"))


def plan_mix(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, size: Column | None = None, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target and copies, the number of times the mix takes each row.

    A source's rate is target / source_size; a row is taken floor(rate) times, and once more with
    probability equal to the fraction, by a hash of seed and row. weights repeat over the sources by code
    point, null last. Defined cases: a null text has size 0; a source of size 0 has target 0 and is
    not taken; rows that agree in doc_id (and, without one, in text) share their draw; an empty table
    gives an empty result; columns of the input named like an added one are replaced.
    """
    return _planned(_sized(docs, size, seed), weights, cap)


def _sized(docs: DataFrame, size: Column | None, seed: int) -> DataFrame:
    size = words(F.col("text")) if size is None else size
    return docs.drop(*ADDED).select("*", size.alias("size"), draw(seed, F.col("doc_id"), F.col("text")).alias("_draw"))


def _key(source: str) -> Column:
    """A source as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(source).cast("string")), F.lit(""))


def _planned(docs: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    per = cut(source_targets(docs, F.col("size"), weights, cap).withColumnsRenamed({"source": "_source", "rows": "_rows"}))
    if per.count() <= FEW:
        joined = docs.join(F.broadcast(per), docs["source"].eqNullSafe(per["_source"]), "left").drop("_source", "_rows")
    else:  # texts are shuffled by source, those of a frequent one in parts
        per = per.withColumn("_key", _key("_source")).drop("_source")
        rows = per.agg(F.sum("_rows")).first()[0]
        joined = join_counted(docs.withColumn("_key", _key("source")), per, "_key", "_rows", rows).drop("_key", "_rows")
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(cap)))).otherwise(0.0)
    extra = F.col("_draw") < rate - F.floor(rate)
    return joined.withColumn("copies", F.floor(rate) + extra.cast("long")).drop("_draw")


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed rows themselves, with the columns of docs: each row of plan_mix as often as it is taken."""
    planned = plan_mix(docs, **options)
    copies = F.expr("explode(array_repeat(0, cast(copies as int)))").alias("_copy")
    return planned.select("*", copies).drop("_copy", *ADDED)


def mix_report(docs: DataFrame, weights: Sequence[int] = (5, 2, 1), cap: int = 3, size: Column | None = None, seed: int = 17) -> DataFrame:
    """doc_id, size, source_size, target and taken, size times copies, of every row of plan_mix; texts are read once."""
    sized = cut(_sized(docs.select("doc_id", "source", "text"), size, seed).select("doc_id", "source", "size", "_draw"))
    taken = (F.col("size") * F.col("copies")).alias("taken")
    return _planned(sized, weights, cap).select("doc_id", "size", "source_size", "target", taken)


#: The same in SQL.
MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), p AS (
  SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3)]::BIGINT AS w
  FROM d GROUP BY source
), q AS (
  SELECT *, sum(source_size) OVER ()::BIGINT
      - coalesce(sum(3 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS room,
    sum(w) OVER (ORDER BY source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM p
), level AS (
  SELECT room, rest FROM q WHERE 3 * source_size * rest >= w * room ORDER BY rest DESC LIMIT 1
), t AS (
  SELECT source, source_size, least((3 * source_size)::DOUBLE, (w * level.room)::DOUBLE / level.rest::DOUBLE) AS target FROM q, level
), r AS (
  SELECT d.*, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN least(t.target / t.source_size, 3.0::DOUBLE) ELSE 0.0::DOUBLE END AS rate,
    ('0x' || left(md5('17:' || coalesce(doc_id::VARCHAR, '~' || text, '~')), 13))::BIGINT / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  size * (floor(rate)::BIGINT + (CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)) AS taken
FROM r
"""
