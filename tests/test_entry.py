"""Every query of the library runs, and equals its SQL where it has one."""

import pytest
from oracle import connect, differences

import __spark_entry__ as entry
from likeness import oracles, queries

ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(spark, data, con, name):
    df = queries.queries()[name](spark, data)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) <= set(entry.queries())
    assert entry.entry(spark).columns == ["threshold", "f1", "recall_10", "mrr"]
