"""Every registered query on the smallest tables, checked by DuckDB where SQL can say it."""

import os

import pytest

from tests.compare import connect, differences
from textscore import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
ORACLES = catalog.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    if name in ORACLES:
        assert differences(df, con, ORACLES[name]) == ""
    else:
        assert df.count() > 0


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(catalog.queries())
