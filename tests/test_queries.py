"""Every registered query with SQL gives what DuckDB gives on the smallest tables."""

import decimal
import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from ledgermatch import queries as recon

SF = "/root/testdata/sf0.001"


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(recon.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    df = recon.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(map(plain, r)) for r in df.select(*columns).collect()), key=repr)
    rel = con.execute(recon.ORACLE_SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() == 13
    assert set(recon.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
