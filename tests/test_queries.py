import pytest
from oracle import assert_same

from corvane.plans import answer_queries, data_queries, retrieval_queries, text_queries

MODULES = (text_queries, retrieval_queries, data_queries, answer_queries)
SF = "/root/testdata/sf0.001"
SQL = {k: (m.QUERIES[k], s) for m in MODULES for k, s in m.ORACLE.items()}
REST = {k: q for m in MODULES for k, q in m.QUERIES.items() if k not in m.ORACLE}


@pytest.mark.parametrize("name", SQL)
def test_query_agrees_with_sql(spark, name):
    assert_same(spark, *SQL[name], SF)


@pytest.mark.parametrize("name", REST)
def test_query_without_sql_has_rows(spark, name):
    assert REST[name](spark, SF).count()


def test_entry_and_registry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count()
    assert set(e.oracle_sql()) <= set(e.queries())


def test_stream_and_batch_limits_agree(spark):
    batch = {tuple(r) for r in data_queries.rate_limit_replay(spark, SF).collect()}
    assert batch == {tuple(r) for r in data_queries.stream_rate_limit(spark, SF).collect()}
    assert {True, False} == {r[2] for r in batch}
