"""Every registered query against its SQL twin on the smallest tables."""

import os

import pytest

import __spark_entry__ as entry
import catalog
import oracle

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.load()[0]))
def test_query(spark, con, name):
    df = catalog.load()[0][name](spark, SF)
    sql = catalog.load()[1].get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert oracle.compare(df, con, sql) is None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
