"""The contract queries against DuckDB on the smallest tables."""

import duckdb
import pytest
from sqlverdict import contract

from tests.conftest import SF


@pytest.fixture(scope="module")
def db():
    connection = duckdb.connect()
    for t in contract.TABLES:
        connection.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return connection


def plain(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) if isinstance(v, int | float) and not isinstance(v, bool) or type(v).__name__ == "Decimal" else str(v)


@pytest.mark.parametrize("name", contract.SQL)
def test_query(spark, db, name):
    found = contract.queries()[name](spark, SF)
    want = db.sql(contract.oracle_sql()[name])
    names = sorted(found.columns)
    assert names == sorted(want.columns)
    have = sorted(repr([plain(r[n]) for n in names]) for r in found.collect())
    assert have == sorted(repr([plain(r[want.columns.index(n)]) for n in names]) for r in want.fetchall())


def test_every_query_has_sql():
    assert contract.queries().keys() == contract.oracle_sql().keys()


def test_known_answers(spark):
    assert tuple(contract.queries()["bag_diff_summary"](spark, SF).first()) == (1500, 1426, 316, 242)
