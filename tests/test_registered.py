import duckdb
import pytest

import __spark_entry__ as entry
from lodestone import catalog, oracle
from tools.check import TABLES, rows

FOLDER = "/root/testdata/sf0.001"
# The recursive SQL twins need many seconds; tools/check.py runs them all.
SLOW = {"semantic_dedup_kept"}


def test_every_query_has_a_twin():
    assert set(catalog.QUERIES) == set(oracle.SQL)
    assert set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - SLOW))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    got = entry.queries()[name](spark, FOLDER).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
