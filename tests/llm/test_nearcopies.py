import random

import numpy as np

import corpus_pipeline
from helixlake.llm import linededup, nearcopies, quality
from tests.llm.test_quality import corpus


def brute(rows):
    """The row that stays of each group, by exact comparison of all pairs of (doc_id, text)."""
    sets = []
    for _, text in rows:
        words = [str(w, "utf-8") for w in (text or "").encode().lower().split()]
        sets.append({tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, x in enumerate(sets):
        for j, y in enumerate(sets[:i]):
            if x == y or 5 * len(x & y) >= 4 * len(x | y):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(rows[i])
    return groups.values()


def edited(r, own, words, n):
    copy = list(own)
    for at in r.sample(range(len(copy)), n):
        copy[at] = r.choice(words)
    return copy


def test_near_copies_with_ordinary_edits_go(spark):
    r = random.Random(8)
    words = [f"w{i}é" for i in range(3000)]
    texts = [None, "", " \n", "One", "one", "a b c", "A B C D", "a b c", "x " * 20000]
    for _ in range(60):
        own = r.choices(words, k=r.randint(3, 400))
        texts.append(" ".join(own))
        for n in range(r.randint(0, 6)):
            texts.append("\n".join(edited(r, own, words, min(len(own), n * len(own) // 100))).upper())
    ids = r.sample(range(10_000), len(texts))
    table = spark.createDataFrame([(i, t, "clash", 5, "x") for i, t in zip(ids, texts)], "doc_id long, text string, node string, row int, keys string").repartition(5)
    want = sorted(min(g)[0] for g in brute(list(zip(ids, [t or "" for t in texts]))))
    assert sorted(x.doc_id for x in corpus_pipeline.keep_one(spark, table, "").collect()) == want
    assert nearcopies.keep_one(table).columns == table.columns
    assert nearcopies.keep_one(table.limit(0)).count() == 0


def test_copies_of_a_hub_that_are_no_copies_of_each_other(spark):
    r = random.Random(9)
    words = [f"v{i}" for i in range(5000)]
    hub = r.choices(words, k=400)
    rows = [(i, " ".join(edited(r, hub, words, 7))) for i in range(150)] + [(150, " ".join(hub))]
    assert len(brute(rows)) == 1 and len(brute(rows[:-1])) > 100
    kept = [x.doc_id for x in nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert 0 in kept and len(kept) <= 2  # a pair at 0.83 is missed with a chance of 0.003


def test_pairs_at_the_threshold_are_found():
    r = random.Random(10)
    met = {0.8: 0, 0.9: 0}
    for k in range(400):
        own = [f"u{k}x{i}" for i in range(400)]
        for at, kept in ((0.8, 355), (0.9, 380)):
            other = own[:kept] + [f"n{k}x{i}" for i in range(400 - kept)]
            x, y = (nearcopies.shingles(" ".join(t).encode())[1] for t in (own, other))
            assert at - 0.005 < len(np.intersect1d(x, y)) / len(np.union1d(x, y)) < at + 0.005
            fps = np.stack([nearcopies.fingerprint(x), nearcopies.fingerprint(y)])
            key, after = nearcopies.segment_keys(fps)
            chains = [all((int(a ^ b) >> nearcopies.SEGMENT * (3 - n)).bit_count() <= n * nearcopies.TAU // nearcopies.RING for n in (2, 3)) for i, j, a, b in zip(*key, *after) if i == j]
            met[at] += any(chains) and np.bitwise_count(fps[0] ^ fps[1]).sum() <= nearcopies.TAU
    assert met[0.8] >= 388 and met[0.9] == 400


def test_fingerprints_are_those_of_a_plain_count():
    r = np.random.default_rng(1)
    for n in (1, 2, 3, 4, 5, 31, 32, 33, 1000, 140_000):
        x = r.integers(0, 1 << 63, n, np.uint64)
        rows = x[:, None] * nearcopies._FACTORS
        rows ^= rows >> np.uint64(32)
        bits = np.unpackbits(rows.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=int)
        assert (np.unpackbits(nearcopies.fingerprint(x).view(np.uint8), bitorder="little") == (bits * 2 > n)).all()
    key, after = nearcopies.segment_keys(nearcopies.fingerprint(x)[None])
    bits = np.unpackbits(nearcopies.fingerprint(x).view(np.uint8), bitorder="little")
    ring, size = nearcopies.RING, nearcopies.SEGMENT
    value = lambda k: int("".join(map(str, bits[k % ring * size : k % ring * size + size][::-1])), 2)
    assert all(key[0, k] == k << size | value(k) and after[0, k] == value(k + 1) << size | value(k + 2) for k in range(ring))


def test_pipeline_drops_near_copies_after_line_dedup(spark, tmp_path):
    rows = [(i, t + ("\nthis notice stands in many documents" if i % 3 == 0 else "")) for i, t, _ in corpus(120, 5)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, ""), (2001, None)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, _, y in corpus(120, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    good = quality.keep_good(docs, lab)
    left = [(r.doc_id, r.text or "") for r in linededup.dedup(good).collect()]
    assert {r.doc_id for r in got} == {min(g)[0] for g in brute(left)} and 1000 in dict(left) and 1000 not in {r.doc_id for r in got}


def test_rows_with_repeated_or_unknown_ids(spark):
    rows = [(1, "one two three four five six", "a"), (1, "quite other words stand in here", "b"), (2, "quite other words stand in here", "c"), (None, "only without any id at all", "d"), (None, "only without any id at all", "e"), (None, "one two three four five six", "f"), (3, "last", "g"), (3, "last", "g")]
    got = nearcopies.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(1, rows[0][1]), (1, rows[1][1]), (0, rows[3][1]), (3, "last")])


def test_sizes_of_similar_sets_share_a_band():
    sizes = np.unique(np.concatenate([np.arange(1, 6000), 2 ** np.arange(13, 30), 5 ** np.arange(1, 12), 4 * 5 ** np.arange(1, 11)]))
    own, upper = nearcopies.size_bands(sizes)
    assert ((upper == own) | (upper == own + 1)).all() and own.max() < nearcopies.MOST_BANDS
    for i, n in enumerate(sizes[:6000]):
        for m in (n, n + 1, 5 * n // 4 - 1, 5 * n // 4):
            if n <= m and 5 * n >= 4 * m:
                assert nearcopies.size_bands(np.array([m]))[0][0] in (own[i], upper[i])
