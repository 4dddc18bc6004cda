import duckdb

import __spark_entry__

SF = "/root/testdata/sf0.001"


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


def test_sql_is_of_registered_queries():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pricing_summary_agrees_with_sql(spark):
    name = "pricing_summary"
    got = __spark_entry__.queries()[name](spark, SF)
    con = duckdb.connect()
    con.sql(f"CREATE VIEW lineitem AS FROM '{SF}/lineitem.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_pricing_summary_of_nulls_and_nothing(spark, tmp_path):
    kind = "l_returnflag string, l_linestatus string, l_quantity double, l_extendedprice double, l_discount double, more int"
    spark.createDataFrame([(None, "O", None, 10.0, None, 1), (None, "O", 2.0, 5.0, 0.5, 1)], kind).write.parquet(f"{tmp_path}/some/lineitem.parquet")
    spark.createDataFrame([], kind).write.parquet(f"{tmp_path}/none/lineitem.parquet")
    query = __spark_entry__.queries()["pricing_summary"]
    assert [tuple(r) for r in query(spark, f"{tmp_path}/some").collect()] == [(None, "O", 2.0, 15.0, 2.5, 7.5, 2)]
    assert query(spark, f"{tmp_path}/none").count() == 0
