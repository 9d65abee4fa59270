"""Every registered query of the reader and the relational operators against its SQL."""

import os

import duckdb
import pytest

from quire.plans import catalog

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


def canonical(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr(tuple(int(r[i]) if isinstance(r[i], float) and r[i].is_integer() else r[i] for i in order)) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the driver's tables")
@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, tables, name):
    got = catalog.QUERIES[name](spark, DATA)
    want = tables.execute(catalog.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert canonical(got.collect(), got.columns) == canonical(want.fetchall(), names)
    spark.catalog.clearCache()
