"""Queries of the text problems run; those with SQL give the same rows."""

import pytest
from conftest import compared

from vellumry.llm import catalog

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        left, right = compared(spark, data, QUERIES[name], SQL[name])
        assert left == right
    else:
        QUERIES[name](spark, data).toPandas()


def test_first_query_of_each_problem():
    first = {}
    for name in QUERIES:
        first.setdefault(name.split("_")[0], name)
    assert first == {"p2": "p2_found", "p5": "p5_found", "p6": "p6_ids", "p7": "p7_found", "p8": "p8_found"}


def test_nothing_else_imports_this_package():
    import os
    import re

    import vellumry

    root = os.path.dirname(vellumry.__file__)
    for folder, _, names in os.walk(root):
        if os.path.basename(folder) != "llm":
            for name in names:
                if name.endswith(".py"):
                    with open(os.path.join(folder, name)) as f:
                        assert not re.search(r"import.*\bllm\b|from vellumry\.llm", f.read()), name
