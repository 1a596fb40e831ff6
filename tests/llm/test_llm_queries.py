import pytest

from boxloom.llm.queries import QUERIES, SQL
from tests.compare import connect, same


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, name):
    same(QUERIES[name](spark, tables), connect(tables), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tables, name):
    df = QUERIES[name](spark, tables)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)
