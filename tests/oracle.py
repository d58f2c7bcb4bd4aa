"""Run a registered query and its SQL over the same tables and compare all rows."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(sorted((plain(k), plain(y)) for k, y in x.items()))
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x if not isinstance(x, bool) else bool(x)


def compare(df, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns), (sorted(names), sorted(df.columns))
    order = sorted(names)
    want = sorted(repr(tuple(plain(dict(zip(names, row))[c]) for c in order)) for row in found.fetchall())
    got = sorted(repr(tuple(plain(row[c]) for c in order)) for row in df.collect())
    assert len(got) == len(want), (len(got), len(want))
    odd = [(g, w) for g, w in zip(got, want) if g != w]
    assert not odd, (len(odd), odd[:3])
    return len(got)
