import pytest
from oracle import agree

from keyloom.plans import queries as core
from keyloom.plans import store_queries  # noqa: F401

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(core.SQL))
def test_against_sql(spark, name):
    agree(spark, SF, core.QUERIES[name], core.SQL[name])


def test_flagship(spark):
    assert core.flagship(spark, "/root/testdata/sf0.001").count() > 0
