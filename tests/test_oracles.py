import pytest
from oracle_check import connect, differences

from packwright.plans.oracles import ORACLES
from packwright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert differences(spark, con, QUERIES[name], ORACLES[name], SF) == ""


def test_every_registered_query_has_a_result(spark):
    for name in sorted(set(QUERIES) - set(ORACLES)):
        QUERIES[name](spark, SF).count()
