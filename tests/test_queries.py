"""Every registered query against its SQL."""

import pytest

from semrank.plans import registry
from tests.oracle import connect, differences

SF = "/root/testdata/sf0.001"
WITHOUT_SQL = sorted(registry.queries().keys() - registry.oracle_sql().keys())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_equals_sql(spark, con, name):
    assert differences(registry.queries()[name](spark, SF), con, registry.oracle_sql()[name]) == []


@pytest.mark.parametrize("name", WITHOUT_SQL)
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0
