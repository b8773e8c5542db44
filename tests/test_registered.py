"""Every registered query against its SQL twin, on whole tables."""

import compare
import pytest

import __spark_entry__ as registered
from conftest import SF

QUERIES, ORACLES = registered.queries(), registered.oracle_sql()


@pytest.fixture(scope="module")
def db():
    return compare.database(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        assert compare.differences(db, df, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    assert registered.entry(spark).count() > 0
