import pytest

from gistmill import queries as Q
from tests.parity import assert_same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_same_as_sql(spark, name):
    assert_same(spark, Q.QUERIES[name], Q.ORACLE_SQL[name], SF)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
