"""Every query with SQL is held to DuckDB on the same tables, and every other one must run."""

import glob
import math
import os

import duckdb
import pytest

from corpuscle.plans import all_queries, all_sql


def cell(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 4) + 0.0
    return v if v is None else str(v)


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return c


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf, duck, name):
    df = all_queries()[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(cell(r[c]) for c in columns) for r in df.collect()), key=str)
    if name not in all_sql():
        return
    found = duck.execute(all_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(cell(r[i]) for i in at) for r in found.fetchall()), key=str)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["doc_id", "chunk_index", "total_chunks", "text"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
