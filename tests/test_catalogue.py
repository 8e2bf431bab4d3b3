"""Every catalogue query against its SQL, on the smallest tables."""

import os

import duckdb
import pytest

from quern.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def views(data):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{data}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query_equals_its_sql(spark, data, views, name):
    found = registry.QUERIES[name](spark, data)
    cursor = views.execute(registry.SQL[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(found.columns)
    want = sorted(repr([plain(r[names.index(c)]) for c in found.columns]) for r in cursor.fetchall())
    assert sorted(repr([plain(v) for v in r]) for r in found.collect()) == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
