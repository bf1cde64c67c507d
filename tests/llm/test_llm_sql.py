import pytest
from grovemap.llm import registry
from oracle import both


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL | registry.SHOWN_SQL))
def test_query_equals_its_sql(spark, name):
    got, want = both(spark, (registry.QUERIES | registry.SHOWN)[name], (registry.ORACLE_SQL | registry.SHOWN_SQL)[name], "/root/testdata/sf0.001")
    assert got == want
