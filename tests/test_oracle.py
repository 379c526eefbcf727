"""Every query that has a SQL form, against that SQL on the smallest tables."""

import pytest

from checks.compare import compare, connect
from checks.oracle import ORACLE
from checks.queries import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(REGISTRY)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_as_sql(spark, con, name):
    assert compare(spark, con, SF, name)[0] == "ok"
