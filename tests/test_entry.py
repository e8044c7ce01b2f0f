"""Every registered query with SQL gives the SQL's rows on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from tarnmill import oracle
from tarnmill import queries as own

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="needs the driver's tables")


def canon(rows):
    return sorted((tuple(round(v, 5) if isinstance(v, float) else v for v in r) for r in rows), key=repr)


@needs_data
@pytest.mark.parametrize("name", sorted(own.queries()))
def test_query(spark, name):
    got = own.queries()[name](spark, DATA)
    if name not in oracle.ORACLE:
        assert got.count() > 0
        return
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want = db.sql(oracle.ORACLE[name])
    assert set(want.columns) == set(got.columns)
    assert canon(got.select(*want.columns).collect()) == canon(want.fetchall())


@needs_data
def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
