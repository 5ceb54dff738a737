"""Every named query against its SQL twin over the small test tables."""

import pytest

import compare
from billmill.plans.catalog import QUERIES


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.duck(sf_dir)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf_dir, name):
    problem, _ = compare.difference(QUERIES[name], spark, con, sf_dir)
    assert problem is None, problem


def test_entry_points():
    import __spark_entry__ as entry

    assert entry.queries().keys() >= entry.oracle_sql().keys()
    assert len(entry.oracle_sql()) > 150
