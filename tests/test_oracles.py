"""Every query of the inventory plans gives the rows of its SQL on the smallest tables."""

import os

import duckdb
import pytest

from tallyforge.plans import inventory

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(tuple(str(r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(inventory.oracle_sql()))
def test_oracle(spark, duck, name):
    got = inventory.queries()[name](spark, SF)
    want = duck.execute(inventory.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, map(tuple, got.collect())) == rows(columns, want.fetchall())
