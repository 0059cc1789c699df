"""Every registered query of the market-data side runs; those with SQL agree with DuckDB on the same tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from tests.conftest import SF
from tidemark.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else f"{v + 0.0:.10g}"
    if isinstance(v, decimal.Decimal):
        return f"{v:.6f}"
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    if name not in registry.ORACLE_SQL:
        assert columns
        return
    rel = duck.sql(registry.ORACLE_SQL[name])
    assert columns == sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    assert rows == sorted(tuple(plain(r[i]) for i in at) for r in rel.fetchall())
