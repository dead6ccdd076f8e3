"""Every core query against its SQL on the smallest tables."""

import pytest

from tests.oracle import connect, normal
from tessera.plans import answer_queries, benchmark, general_queries, statement_queries, store_queries, text_queries

QUERIES = {k: (f, m.SQL.get(k)) for m in (general_queries, text_queries, store_queries, answer_queries, statement_queries, benchmark) for k, f in m.QUERIES.items()}


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    query, sql = QUERIES[name]
    got = query(spark, tables).toPandas()
    if sql is None:
        assert len(got.columns)
        return
    want = connect(tables).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_entry_has_schema(spark, tables):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    df = e.entry(spark)
    assert "query_id" in df.columns
