"""Line items summed up by flag and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per return flag and line status: sums, averages and the count of its line items.

    Sums are of decimals, so that they don't depend on the order of rows; a null counts in no sum or average.
    A single exchange of partial sums, one row per group and task.
    """
    money = "decimal(12,2)"
    price, off = F.col("l_extendedprice").cast(money), F.col("l_discount").cast(money)
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(
        "l_returnflag", "l_linestatus", F.col("l_quantity").cast(money).alias("quantity"), price.alias("price"), (price * (1 - off)).alias("paid")
    )
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        F.sum("quantity").cast("double").alias("sum_qty"),
        F.sum("price").cast("double").alias("sum_price"),
        F.sum("paid").cast("double").alias("sum_paid"),
        (F.sum("price").cast("double") / F.count("price")).alias("avg_price"),
        F.count("*").alias("n_rows"),
    )


#: The same in SQL.
PRICING_SQL = """
SELECT l_returnflag, l_linestatus,
  sum(l_quantity::DECIMAL(12,2))::DOUBLE AS sum_qty,
  sum(l_extendedprice::DECIMAL(12,2))::DOUBLE AS sum_price,
  sum(l_extendedprice::DECIMAL(12,2) * (1 - l_discount::DECIMAL(12,2)))::DOUBLE AS sum_paid,
  sum(l_extendedprice::DECIMAL(12,2))::DOUBLE / count(l_extendedprice) AS avg_price,
  count(*) AS n_rows
FROM lineitem GROUP BY l_returnflag, l_linestatus
"""
