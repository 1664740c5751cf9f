"""Every query on nets and chains against its SQL."""

import pytest

from fillgap import plans
from tests.duck import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_sql(spark, name):
    same(spark, SF, plans.QUERIES[name], plans.SQL[name])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
