"""Every registered query of the general library against DuckDB, on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import difference, oracle

from docquarry.plans import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    return oracle(SF)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, con, name):
    assert difference(spark, QUERIES[name], ORACLE_SQL[name], SF, con) is None


def test_sketches_are_near(spark):
    for row in QUERIES["table_sketches"](spark, SF).collect():
        assert abs(row["approx"] - row["exact"]) <= 0.1 * row["exact"]
        assert abs(row["hll"] - row["exact"]) <= 0.1 * row["exact"]
        assert abs(row["median"] - row["exact_median"]) <= 0.05 * row["exact_median"]
