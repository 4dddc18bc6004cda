"""Every query that has SQL gives what its SQL gives, in the same columns."""

import duckdb
import pytest

import __spark_entry__
from sparkloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_its_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS FROM '{SF}/{t}.parquet'")
    got, want = QUERIES[name](spark, SF), con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(want.columns)
    assert sorted(map(tuple, got.select(columns).collect()), key=str) == sorted(want.select(*columns).fetchall(), key=str)


def test_entry_has_every_query():
    names = {"op1_mix", "op2_chat", "op3_urls", "op4_shards", "op5_bpe", "op6_simhash", "op7_topk", "op8_quality", "op9_secrets", "op10_suffix"}
    names |= {"op11_divergence", "op12_lm", "op13_resample", "pipeline", "pricing_summary"}
    assert set(__spark_entry__.queries()) == names
