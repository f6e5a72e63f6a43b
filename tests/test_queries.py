import pytest

from conftest import same_as_sql
from nearfield.queries import ORACLE_SQL, QUERIES


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, name):
    same_as_sql(spark, QUERIES[name], ORACLE_SQL[name])
