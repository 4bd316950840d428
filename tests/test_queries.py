import pytest

from lexshift.plans.catalog import ORACLES, QUERIES
from tests.oracle import compare, connection

SF = "/root/testdata/sf0.001"
#: Without SQL, and long: they have tests of their own or run in the comparison at sf0.01.
LONG = {"lr_newsense", "dt_newsense", "lsa_ecdf", "flow_residual", "topic_model"}


@pytest.fixture(scope="module")
def duck():
    return connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    said, _ = compare(spark, duck, SF, QUERIES[name], ORACLES[name])
    assert not said


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - LONG))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0
