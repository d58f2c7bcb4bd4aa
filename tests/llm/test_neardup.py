import numpy as np

from helixlake.llm import neardup, vectors


def brute(rows, similar=0.93):
    """(n_links, component) per row by comparing everything."""
    ok = [r[2] is not None and r[1] is not None and len(r[1]) == 8 and all(c is not None and np.isfinite(c) for c in r[1]) and any(r[1]) for r in rows]
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    x = [np.array(r[1], float) if o else None for r, o in zip(rows, ok)]
    for i in range(n):
        for j in range(i):
            if ok[i] and ok[j] and rows[i][2] == rows[j][2] and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= similar:
                links[i] += 1
                links[j] += 1
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)], rows[i][0] == least[find(i)]) for i in range(n))


def table(seed, n=260):
    r = np.random.default_rng(seed)
    rows, centres = [], r.normal(size=(40, 8))
    for i in range(n):
        c = centres[r.integers(40)]
        v = (c + r.normal(size=8) * r.choice([0.05, 0.2, 0.5])) * r.choice([1.0, 7.0])
        rows.append((int(i * 3 % 1009), [float(np.float32(a)) for a in v], int(r.integers(3))))
    rows += [(5000 + i, rows[0][1], rows[0][2]) for i in range(30)]
    rows += [(6000, None, 1), (6001, [0.0] * 8, 1), (6002, [float("nan")] + [1.0] * 7, 1), (6003, [None] + [1.0] * 7, 1), (6004, rows[0][1], None), (6006, [float("inf")] + [1.0] * 7, 1), (6007, [], 1)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], "vec_id long, embedding array<float>, label int, cid string, n int").repartition(5)


def test_matches_brute_force(spark):
    for seed, leaf in ((1, 96), (2, 12)):
        rows = table(seed)
        got = sorted(tuple(r) for r in neardup.link_vectors(frame(spark, rows), leaf=leaf, margin=0.4, trees=8).collect())
        assert got == brute(rows)


def test_hot_groups_are_cut_into_blocks(spark, monkeypatch):
    rows = table(3)
    cut = vectors.in_blocks
    monkeypatch.setattr(vectors, "in_blocks", lambda r, g, s, size=7: cut(r, g, s, size))
    got = sorted(tuple(r) for r in neardup.link_vectors(frame(spark, rows), margin=0.4, trees=8).collect())
    assert got == brute(rows)


def test_edge_tables(spark):
    none = frame(spark, [])
    assert neardup.link_vectors(none).count() == 0
    bad = frame(spark, [(1, None, 1), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], None)])
    assert sorted(tuple(r) for r in neardup.link_vectors(bad).collect()) == [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True)]
    again = frame(spark, [(1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (None, [1.0, 0.0], 1)])
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in neardup.link_vectors(again).collect()) == [(0, 2, 1, False), (1, 2, 1, True), (1, 2, 1, True)]


def test_registered_parameters_find_the_links(spark):
    r = np.random.default_rng(9)
    centres = r.normal(size=(120, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    rows = []
    for i in range(1800):
        k = int(r.integers(120)) if i % 3 else 0
        rows.append((i, [float(np.float32(a)) for a in centres[k] + r.normal(size=64) * r.choice([0.1, 0.2, 0.27]) / 8], k % 3))
    table = spark.createDataFrame([(*x, 1) for x in rows], "vec_id long, embedding array<float>, label int, cid int").repartition(6)
    got = {x.vec_id: (x.n_links, x.component_id) for x in neardup.link_vectors(table).collect()}
    x, label = np.array([v for _, v, _ in rows]), np.array([c for *_, c in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    links = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(links, False)
    assert sum(n for n, _ in got.values()) >= 0.999 * links.sum() > 100_000
    assert all(got[i][0] <= links[i].sum() for i in got)


def test_vectors_of_several_lengths(spark):
    rows = [(1, [1.0, 0.0], 1), (2, [1.0, 0.01], 1), (3, [1.0, 0.0, 0.0], 1), (4, [1.0, 0.0, 0.02], 1), (5, [5.0], 1), (6, [2.0], 1), (7, [1.0, 0.0], 2)]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in neardup.link_vectors(frame(spark, rows)).collect())
    assert got == [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 1, 3), (5, 1, 5), (6, 1, 5), (7, 0, 7)]
