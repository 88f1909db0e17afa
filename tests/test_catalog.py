"""Every query with an oracle gives the oracle's rows on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__
from lociflow.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(rows, columns):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    value = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_oracle(spark, tables, name):
    got = catalog.queries()[name](spark, FOLDER)
    want = tables.execute(catalog.oracle_sql()[name])
    columns = [x[0] for x in want.description]
    assert sorted(columns) == sorted(got.columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).limit(1).count() == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
