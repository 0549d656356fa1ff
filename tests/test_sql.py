import pytest

from folio.queries import ORACLE_SQL, QUERIES
from tests.oracle import compare

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_as_sql(spark, name):
    assert compare(spark, name, SF, QUERIES, ORACLE_SQL) > 0


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_query_has_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0
