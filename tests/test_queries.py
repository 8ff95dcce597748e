"""Each query with SQL gives the rows of its SQL."""

import pytest

from deltaloom import queries


def rows_of(rows):
    return sorted(repr(sorted(r.items())) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_gives_the_rows_of_its_sql(spark, duck, small, name):
    got = [r.asDict() for r in queries.QUERIES[name](spark, small).collect()]
    assert rows_of(got) == rows_of(duck(queries.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_without_sql_gives_a_row_for_each_pair(spark, small, name):
    assert queries.QUERIES[name](spark, small).count() == queries.table(spark, small, "conversations").count()


def test_filters_and_columns_reach_the_scan(spark, small):
    plan = queries.chunk_count(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
