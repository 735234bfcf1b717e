"""Every registered query against its reference SQL on the smallest tables."""

import os
import sys

import pytest

import workload
from workload.check import compare, connect

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.fixture(scope="module", autouse=True)
def compiled(spark):
    """Run these queries as a cluster would, with code generation."""
    names = ["spark.sql.codegen.wholeStage", "spark.sql.codegen.factoryMode"]
    before = [spark.conf.get(n) for n in names]
    for n, v in zip(names, ["true", "FALLBACK"]):
        spark.conf.set(n, v)
    yield
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.mark.parametrize("name", list(workload.QUERIES))
def test_query(spark, duck, name):
    result = compare(spark, duck, SF_DIR, name, workload.QUERIES[name], workload.SQL.get(name))
    assert result.startswith(("ok", "rows-only")) and "TYPES" not in result, result


def test_entry(spark):
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
