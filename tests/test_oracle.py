import os

import pytest

from edittide.plans.queries import ORACLE, QUERIES
from tests.oracle import compare, connect

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_sql(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLE[name], SF) is None
