import duckdb
import pytest

from casefile import queries

SF = "/root/testdata/sf0.001"


def test_every_query_has_sql():
    assert set(queries.QUERIES) - set(queries.SQL) == {"embed_column"}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in ("documents", "embeddings", "benchmark", "conversations", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    assert columns == sorted(con.sql(queries.SQL[name]).columns)
    exact = lambda rows: sorted(repr(tuple(round(v, 9) if isinstance(v, float) else v for v in r)) for r in rows)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.SQL[name]})").fetchall()
    assert exact(got.select(*columns).collect()) == exact(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
