"""Every registered query with SQL gives the rows that DuckDB gives."""

import math
import os

import duckdb
import pytest

from terravox.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return repr([plain(x) for x in v])
    return repr(bytes(v) if isinstance(v, bytearray) else v)


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from read_parquet('{p + '/*.parquet' if os.path.isdir(p) else p}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    got = df.collect()
    cursor = duck.execute(registry.ORACLE_SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    mine = sorted(tuple(plain(row[c]) for c in order) for row in got)
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in cursor.fetchall())
    assert mine == theirs


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.ORACLE_SQL.keys()))
def test_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_entry():
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
