"""Registered queries against their SQL. Set STATEWATCH_ALL=1 for every query; by default one in six."""

import os

import pytest

from statewatch.catalog import ORACLES, QUERIES
from tests.compare import compare, connect

SF = os.environ.get("STATEWATCH_SF", "/root/testdata/sf0.001")
NAMES = sorted(ORACLES)
if not os.environ.get("STATEWATCH_ALL"):
    NAMES = NAMES[::6]


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="shared tables not present")
@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(spark, con, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name], con) is None


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
