"""Every registered query against its SQL on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from tools.check import TABLES, rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_keys():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("key", sorted(entry.oracle_sql()))
def test_matches_sql(spark, con, key):
    df = entry.queries()[key](spark, SF)
    ours = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(entry.oracle_sql()[key])
    assert ours == rows([c[0] for c in rel.description], rel.fetchall())
