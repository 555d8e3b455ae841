"""Every registered change-log query against its SQL twin, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomlog.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not Path(DATA).exists(), reason="the given tables are not here")
@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_equal(spark, duck, name):
    got = catalogue.queries()[name](spark, DATA)
    want = duck.sql(catalogue.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    rows = sorted(repr(tuple(r[c] for c in want.columns)) for r in got.collect())
    assert rows == sorted(map(repr, want.fetchall()))
