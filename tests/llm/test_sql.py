"""Registered queries against their SQL on the driver's tables."""

import pytest
from compare import duck, duck_rows, spark_rows
from paths import SF, SF_CHECKED

from leadcurve.llm import oracle, queries


@pytest.mark.parametrize("folder", [SF, SF_CHECKED])
@pytest.mark.parametrize("name", sorted(oracle.ORACLE_SQL))
def test_matches_sql(spark, name, folder):
    assert spark_rows(queries.QUERIES[name](spark, folder)) == duck_rows(duck(folder), oracle.ORACLE_SQL[name])
