"""Compare a Spark result with DuckDB SQL over the same Parquet files."""

import duckdb


def same(df, sql, tables):
    con = duckdb.connect()
    for name, path in tables.items():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    key = lambda rows: sorted(map(repr, rows))
    assert key(tuple(r[c] for c in order) for r in df.collect()) == key(tuple(dict(zip(names, r))[c] for c in order) for r in want.fetchall())
