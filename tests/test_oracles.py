"""Every registered query against its SQL on the smallest tables."""

import os

import pytest

from tests.compare import compare, duck
from quillflow.plans import registry

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", list(registry.load()[0]))
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name) == []


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    queries, sql = registry.load()
    assert set(sql) <= set(queries)
