"""Every registered query of the core against its SQL on the smallest tables."""

import math
from collections import Counter

import pytest

from weftline.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


#: Queries without SQL that find nothing in the smallest tables.
MAY_BE_EMPTY = {"code_flows", "canonical_urls", "fused_urls", "joined_part_texts"}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5)
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    if hasattr(v, "isoformat"):
        return str(v)[:26]
    return v


@pytest.fixture(scope="module")
def duck(data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    from pathlib import Path

    for p in Path(data).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, data, duck, name):
    df = QUERIES[name](spark, data)
    columns = sorted(df.columns)
    rows = Counter(tuple(plain(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(SQL[name])
    assert sorted(rel.columns) == columns
    at = [rel.columns.index(c) for c in columns]
    assert rows == Counter(tuple(plain(r[i]) for i in at) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = QUERIES[name](spark, data)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0 or name in MAY_BE_EMPTY


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
