import pytest

from tests import oracle
from visagelake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, con, name):
    got = oracle.rows_of_spark(registry.QUERIES[name](spark, SF))
    assert got[1]
    if name in registry.ORACLE:
        assert got == oracle.rows_of_duck(con, registry.ORACLE[name])
