import compare
import pytest

import __spark_entry__
from veritrace.plans import queries as core

NAMES = sorted(core.queries())


@pytest.fixture(scope="module")
def duck(sf):
    return compare.connect(sf)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, duck, name):
    found = core.queries()[name](spark, sf).toPandas()
    if sql := core.oracle_sql().get(name):
        assert compare.rows(found) == compare.rows(duck.sql(sql).df())
    else:
        assert len(found.columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
