"""Every registered query beside its SQL on the smallest tables."""

import pytest

from __spark_entry__ import entry
from compare import compare, oracle
from rollbook.plans import all_oracles, all_queries


@pytest.fixture(scope="module")
def con(sf):
    return oracle(sf)


def test_entry(spark):
    assert entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(all_oracles()) <= set(all_queries())


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, sf, con, name):
    sql = all_oracles().get(name)
    if sql is None:
        assert all_queries()[name](spark, sf).count() > 0
    else:
        assert compare(spark, con, sf, name, all_queries()[name], sql) is None
