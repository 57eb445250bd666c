"""Every query of the core library runs; those with SQL give the same rows."""

import pytest
from conftest import compared

from vellumry.plans import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        left, right = compared(spark, data, QUERIES[name], SQL[name])
        assert left == right
    else:
        QUERIES[name](spark, data).toPandas()


def test_entry(spark, data):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_scans_read_few_columns(spark, data):
    """Column pruning reaches the scan."""
    plan = QUERIES["p1_found"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "stdin" not in plan and "description" not in plan
