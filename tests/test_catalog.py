"""Every query against its SQL, on the smallest tables."""

import math
from decimal import Decimal

import pytest

from tessera import catalog

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else v


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rel = tables.sql(catalog.SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert own == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_every_query_has_sql():
    assert set(catalog.QUERIES) == set(catalog.SQL)
