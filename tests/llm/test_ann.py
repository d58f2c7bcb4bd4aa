import numpy as np
from pyspark.sql import functions as F

from helixlake.llm import ann


def every(vec_id):
    return F.pmod(vec_id, F.lit(5)) == 0


def table(seed, n=700):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(25, 6))
    rows = [(i, [float(np.float32(x)) for x in centres[r.integers(25)] * r.choice([1.0, 2.0]) + r.normal(size=6) * 0.4]) for i in range(n)]
    rows += [(n + i, rows[0][1]) for i in range(60)]
    return rows


def brute(rows, k):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    out = {}
    for i, v in rows:
        if i % 5 == 0:
            score = np.einsum("ij,j->i", x, np.array(v))
            order = [j for j in np.lexsort((ids, -score)) if ids[j] != i][:k]
            out[i] = [(int(ids[j]), float(score[j])) for j in order]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(*r, 3, "clash") for r in rows], "vec_id long, embedding array<float>, label int, cid string").repartition(4)


def got(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_all_leaves_give_the_exact_answer(spark, monkeypatch):
    rows = table(1)
    monkeypatch.setattr(ann, "_calibrate", lambda index, probes, tree, k, recall: 10_000)
    want = brute(rows, 20)
    for block in (4096, 50):
        own = got(ann.search(frame(spark, rows), every, block=block))
        assert {q: [i for i, _ in x] for q, x in own.items()} == {q: [i for i, _ in x] for q, x in want.items()}
        assert all(np.allclose([s for _, s in own[q]], [s for _, s in want[q]], rtol=1e-12) for q in want)


def test_recall_against_brute_force(spark):
    rows = table(2, 3000)
    want, own = brute(rows, 20), got(ann.search(frame(spark, rows), every))
    assert np.mean([len({i for i, _ in own[q]} & {i for i, _ in want[q]}) / 20 for q in want]) >= 0.9
    assert all(len(x) == 20 for x in own.values())


def test_edge_tables(spark):
    assert ann.search(frame(spark, []), every).count() == 0
    assert ann.search(frame(spark, [(0, [1.0, 2.0])]), every).count() == 0
    odd = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 1.0]), (3, None), (4, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [0.0, 0.0]), (None, [1.0, 1.0]), (1, [1.0, 0.0]), (5, [float("inf"), 1.0]), (10, [0.0, 0.0])]
    assert got(ann.search(frame(spark, odd), every)) == {0: [(1, 1.0), (2, -1.0)]}
    twice = [(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 1.0])]
    assert {(r.query_id, r.vec_id) for r in ann.search(frame(spark, twice), every, k=1).collect()} == {(0, 1)}


def test_recall_of_registered_parameters_without_structure(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(3000, 64))
    rows = [(i, [float(np.float32(a)) for a in v]) for i, v in enumerate(x / np.linalg.norm(x, axis=1, keepdims=True))]
    own = got(ann.search(frame(spark, rows), lambda vec_id: F.pmod(vec_id, F.lit(20)) == 0))
    x = np.array([v for _, v in rows])
    share = []
    for q in own:
        score = x @ x[q]
        score[q] = -2
        share.append(len({i for i, _ in own[q]} & set(np.argsort(-score, kind="stable")[:20].tolist())) / 20)
    assert len(own) == 150 and np.mean(share) >= 0.9


def test_vectors_of_several_lengths(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.0]), (5, [1.0, 1.0, 0.0]), (6, [2.0, 0.0, 0.0]), (10, [3.0])]
    assert got(ann.search(frame(spark, rows), every)) == {0: [(1, 0.5)], 5: [(6, 2.0)]}


def test_lists_are_full_even_where_leaves_are_small(spark, monkeypatch):
    whole, real = ann.fit, table(9, 300)[:300]
    monkeypatch.setattr(ann, "fit", lambda x: whole(x, leaf_points=3))
    monkeypatch.setattr(ann, "_calibrate", lambda *a: 1)
    out = got(ann.search(frame(spark, real), every))
    assert set(out) == {i for i, _ in real if i % 5 == 0} and {len(x) for x in out.values()} == {20}
    few = real[:7]
    assert {len(x) for x in got(ann.search(frame(spark, few), every)).values()} == {6}
