import duckdb
import pytest

from tessella.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same_rows(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [d[0] for d in want.description]
    df = queries.QUERIES[name](spark, sf).select(names)
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want.fetchall(), key=repr)
