"""Every registered query that has SQL gives the rows that DuckDB gives for it."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from tessella.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(found, names):
    value = lambda v: ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted((tuple(value(r[k]) for k in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, SF)
    got = df.collect()
    assert got or name == "pending_embed"  # here every document has a vector
    if name in registry.ORACLES:
        want = con.execute(registry.ORACLES[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(df.columns)
        assert rows(got, df.columns) == rows(want.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() == 1
    assert registry.FLAGSHIP in entry.queries()
