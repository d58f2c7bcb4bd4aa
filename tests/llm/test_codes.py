import hashlib
import math
import os
import random

import numpy as np

from helixlake.llm import codes
from helixlake.llm.queries import ORACLE, op13_vector_codes
from tests.llm.oracle import same

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001")


def brute(rows, parts=4, entries=256, rounds=4, scale=1024):
    """Rows (vec_id, vector, label) of one length by plain loops: [(vec_id, code, error, label)], the digest."""
    kept = [(i, [math.floor(scale * x) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = len(kept[0][1]) // parts
    cut = lambda v, p: v[p * width : (p + 1) * width]
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[1]))[:entries]
    books = [[cut(v, p) for _, v, _ in first] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p, book in enumerate(books):
            own = {}
            for _, v, _ in kept:
                own.setdefault(near(cut(v, p), book)[1], []).append(cut(v, p))
            books[p] = [[sum(c) // len(c) for c in zip(*own[k])] if k in own else e for k, e in enumerate(book)]
    out = []
    for i, v, g in kept:
        found = [near(cut(v, p), book) for p, book in enumerate(books)]
        out.append((i, bytes(k for _, k in found), sum(f for f, _ in found), g))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def check(spark, rows, **params):
    table = spark.createDataFrame([(i, v, g, 1, "c") for i, v, g in rows], "vec_id long, embedding array<float>, label int, row int, code string").repartition(3)
    want, digest = brute(rows, **params)
    total = {}
    for *_, error, g in want:
        total[g] = total.get(g, 0) + error
    got = codes.compress(table, **params).collect()
    assert sorted(((r.vec_id, bytes(r.code), r.error, r.label_error) for r in got), key=repr) == sorted(((i, c, e, total[g]) for i, c, e, g in want), key=repr)
    assert {r.codebooks_sha256 for r in got} == {digest}


def floats(r, n, spread):
    return [float(np.float32(r.gauss(0, spread))) for _ in range(n)]


def test_codes_are_those_of_plain_loops(spark, monkeypatch):
    monkeypatch.setattr(codes, "BLOCK", 50)
    r = random.Random(1)
    rows = [(i, floats(r, 8, 0.3), r.choice([None, 1, 1, 1, 2])) for i in range(330)]
    rows += [(400, None, 1), (401, [None] + [0.0] * 7, 1), (402, [math.nan] * 8, 2), (403, [math.inf] * 8, None), (404, [0.0] * 8, 3), (405, [0.0] * 8, 3)]
    rows += [(7, floats(r, 8, 0.3), 4), (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (-1, [-0.0001] * 8, 1)]
    r.shuffle(rows)
    check(spark, rows)


def test_few_rows_many_ties_and_wide_values(spark):
    r = random.Random(2)
    check(spark, [(i, [float(r.randint(-1, 1)) for _ in range(4)], 1) for i in range(60)], entries=5)
    check(spark, [(i, floats(r, 12, 4000), i % 3) for i in range(90)], entries=16, rounds=2)
    check(spark, [(3, [0.5, 0.25, -0.5, 1.0], None)])


def test_lengths_that_cannot_be_coded(spark):
    rows = [(1, [0.5] * 4, 1), (2, [0.5] * 5, 1), (3, [], 1), (4, [1e30] * 4, 2), (5, [0.25] * 8, 1), (None, [0.25] * 4, None)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.code and len(r.code), r.error, r.label_error) for r in codes.compress(table).collect()}
    assert got == {1: (4, 0, 0), 2: (None, None, 0), 3: (None, None, 0), 4: (None, None, None), 5: (4, 0, 0), None: (4, 0, 0)}
    assert codes.compress(table.limit(0)).count() == 0


def test_sql_agrees(spark):
    same(op13_vector_codes(spark, SF), ORACLE["op13_vector_codes"], {"embeddings": f"{SF}/embeddings.parquet"})
