import __spark_entry__ as entry


def test_every_sql_has_its_query_and_the_flagship_runs(spark):
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) > 100 and all(callable(f) for f in queries.values())
    out = entry.entry(spark)
    assert "shannon_mean" in out.columns and out.count() > 0
