"""Registered queries over tables that hold what the small ones don't, against their SQL."""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helixlake import plans
from tests.oracle import TABLES, compare

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001")
QUERIES, ORACLE = plans.load()


def with_table(tmp_path, name, df):
    """A folder of the test tables in which one is another."""
    for t in TABLES:
        if t != name:
            (tmp_path / f"{t}.parquet").symlink_to(Path(SF) / f"{t}.parquet")
    df.toPandas().to_parquet(tmp_path / f"{name}.parquet", coerce_timestamps="us", index=False)
    return str(tmp_path)


@pytest.mark.parametrize("name", ["chain_diagnostics", "provenance_chains"])
def test_customers_without_orders_have_an_empty_chain(spark, tmp_path, name):
    customer = spark.read.parquet(f"{SF}/customer.parquet")
    more = customer.limit(2).withColumn("c_custkey", F.col("c_custkey") + 1_000_000)
    compare(QUERIES[name](spark, with_table(tmp_path, "customer", customer.union(more))), ORACLE[name], str(tmp_path))
