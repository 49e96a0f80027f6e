"""Every registered query against DuckDB on the same files; queries without SQL must give rows."""

import duckdb
import pytest

from corpusflow import queries as registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
KINDS = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, sf, db, name):
    df = registry.queries()[name](spark, sf)
    order = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cur = db.execute(sql)
    names = [d[0] for d in cur.description]
    kinds = {d[0]: str(d[1]) for d in cur.description}
    assert sorted(names) == order
    place = [names.index(c) for c in order]
    want = sorted((tuple(plain(r[k]) for k in place) for r in cur.fetchall()), key=repr)
    assert got == want
    for c, k in df.dtypes:
        assert KINDS.get(k, kinds[c]) == kinds[c], (c, k, kinds[c])
