"""Every query with SQL equals it on the small tables, and its columns have the names and the order-free values of the SQL."""

from __future__ import annotations

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from strandline.plans import feed_queries, graph_queries

D = "/root/testdata/sf0.001"
CORE = {**feed_queries.QUERIES, **graph_queries.QUERIES}
ORACLE = {**feed_queries.SQL, **graph_queries.SQL}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in sorted(os.listdir(D)):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{D}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(CORE))
def test_query(spark, duck, name):
    df = CORE[name](spark, D)
    columns = sorted(df.columns)
    rows = Counter(tuple(map(str, r)) for r in df.select(*columns).collect())
    if name in ORACLE:
        listed = ", ".join(f'"{c}"' for c in columns)
        assert rows == Counter(tuple(map(str, r)) for r in duck.execute(f"SELECT {listed} FROM ({ORACLE[name]})").fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns == ["entity_id", "property_id", "version_value", "valid_from", "valid_to"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
