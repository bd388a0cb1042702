from pathlib import Path

import pytest

import __spark_entry__ as entry_points
from sieveline.plans import ORACLES, QUERIES
from sieveline.plans.check import compare, duck

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return duck(SF_DIR)


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["lang", "type", "n_docs", "n_values"] and df.count() > 0
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql_twin(spark, con, name):
    result = compare(spark, con, name, SF_DIR)
    assert result.startswith("ok" if name in ORACLES else "rows-only"), result
