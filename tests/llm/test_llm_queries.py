import duckdb
import pytest

from casefile.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = sorted(map(repr, con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()))
    assert sorted(repr(tuple(r)) for r in got.select(*columns).collect()) == rows
