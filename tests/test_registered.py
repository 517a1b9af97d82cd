"""Every registered query against its SQL twin on the test tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle import compare, connect  # noqa: E402
from tokengrove.catalog import load  # noqa: E402

QUERIES, ORACLES = load()


@pytest.fixture(scope="module")
def duck(small):
    return connect(small)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, small, duck):
    df = QUERIES[name](spark, small)
    if name in ORACLES:
        assert compare(df, duck, ORACLES[name]) is None
    else:
        assert df.count() > 0


def test_entry_is_registered(spark):
    import __spark_entry__ as contract

    assert contract.entry(spark).columns[0] == "repo"
    assert set(contract.oracle_sql()) <= set(contract.queries())
