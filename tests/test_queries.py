import pytest

from tempora.plans import catalog
from tests.oracle import DATA, assert_same

SQL = catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    query = catalog.queries()[name]
    if name in SQL:
        assert_same(spark, query, SQL[name])
    else:
        assert query(spark, DATA).count() > 0


def test_every_oracle_has_a_query():
    assert set(SQL) <= set(catalog.queries())
