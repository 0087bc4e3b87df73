import pytest

import __spark_entry__ as entry
from sparkreel.plans.registry import QUERIES, SQL

from .compare import connect, differences

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert differences(QUERIES[name](spark, FOLDER), db, SQL[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["seq", "pts_hns", "a", "b", "mixed"] and df.count() > 0


def test_registry_names_match():
    assert set(entry.oracle_sql()) <= set(entry.queries())
