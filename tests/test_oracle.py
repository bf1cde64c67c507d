import pytest
from grovemap.plans import queries
from oracle import both


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, queries.QUERIES[name], queries.ORACLE_SQL[name], "/root/testdata/sf0.001")
    assert got == want
