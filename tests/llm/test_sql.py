import compare
import pytest

from veritrace.llm import queries as llm


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, sf, name):
    assert compare.rows(llm.queries()[name](spark, sf).toPandas()) == compare.rows(compare.connect(sf).sql(llm.oracle_sql()[name]).df())
