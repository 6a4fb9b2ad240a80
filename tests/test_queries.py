"""Every query of the library against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from lonja.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents pages labels conversations".split()


@pytest.fixture(scope="module")
def oracle():
    with duckdb.connect() as db:
        for name in TABLES:
            db.sql(f"create view {name} as select * from read_parquet('{SF}/{name}.parquet')")
        yield db


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cells = [tuple(None if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in values]
    return sorted(cells, key=lambda r: tuple((c is None, str(type(c)), c if c is not None else 0) for c in r))


@pytest.mark.parametrize("name", ORACLE_SQL)
def test_query_equals_sql(spark, oracle, name):
    found = QUERIES[name](spark, SF)
    expected = oracle.sql(ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(expected.columns)
    assert rows(found.columns, [tuple(r) for r in found.collect()]) == rows(expected.columns, expected.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
