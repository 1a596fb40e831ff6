import importlib
import os
import subprocess
import sys

import pytest

from tests.compare import connect, same

MODULES = ["core_data", "detection_queries", "dataset_queries", "experiment_queries", "frame_queries", "more_queries", "task_queries"]
LOADED = [importlib.import_module(f"boxloom.plans.{m}") for m in MODULES if importlib.util.find_spec(f"boxloom.plans.{m}")]
QUERIES = {n: q for m in LOADED for n, q in m.QUERIES.items()}
SQL = {n: q for m in LOADED for n, q in m.SQL.items()}


@pytest.fixture(scope="module")
def con(tables):
    return connect(tables)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, tables, con, name):
    same(QUERIES[name](spark, tables), con, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, tables, name):
    df = QUERIES[name](spark, tables)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_import_needs_no_session():
    code = "import __spark_entry__ as d; assert set(d.oracle_sql()) <= set(d.queries())"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__))), capture_output=True).returncode == 0


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() > 0
    assert set(driver.oracle_sql()) <= set(driver.queries())
