"""The operators' queries against their SQL."""

import pytest

from semrank.llm import queries
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differences(queries.queries()[name](spark, SF), con, queries.oracle_sql()[name]) == []
