import pytest
from oracle import assert_same

from corvane.llm import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", registry.ORACLE)
def test_query_agrees_with_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLE[name], SF)


def test_each_operator_has_a_query():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES if n != "pipeline") == list(range(1, 14))
