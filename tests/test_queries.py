import os

import pytest

from helixlake import plans
from tests.oracle import compare

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = plans.load()


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_agrees_with_its_sql(spark, name):
    compare(QUERIES[name](spark, SF), ORACLE[name], SF)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_query_without_sql_runs(spark, name):
    rows = QUERIES[name](spark, SF).collect()
    assert rows
