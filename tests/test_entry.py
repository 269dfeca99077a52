"""The driver's contract: names, shapes, and SQL where it is given."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from shiftspark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_names():
    found, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(found) and set(registry.QUERIES) <= set(found)


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_sql_gives_the_same_rows(spark, duck, name):
    a, b = entry.queries()[name](spark, SF).toPandas(), duck.sql(registry.ORACLE_SQL[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b)
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    pd.testing.assert_frame_equal(a, b, check_exact=True)
