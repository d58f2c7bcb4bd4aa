import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixlake.llm import quality


def corpus(n, seed):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefgh", k=r.randint(2, 8))) for _ in range(900)]
    rows = []
    for i in range(n):
        good = r.random() < 0.7
        own = [r.choice(words) for _ in range(r.randint(5, 120))]
        rows.append((i, " ".join(own) if good else " ".join(w + "!!" for w in own), int(good)))
    return rows


def test_held_out_accuracy_and_inputs(spark):
    rows = corpus(500, 1)
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t, _ in rows], "doc_id long, text string, score double, lang string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    truth = {i: y for i, _, y in rows}
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.97
    flipped = labels.where(~quality.held_out("doc_id"))
    assert {r.doc_id: r.score for r in quality.classify(docs, flipped).collect()} == {r.doc_id: r.score for r in out}
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in out if r.predicted}


def test_features_are_those_of_a_plain_loop():
    raw = "One two  two\nThree-4 é ".encode() * 3
    w, f = quality.words_of(raw)
    plain = raw.split()
    assert len(w) == len(f) == len(plain)
    assert all((w[i] == w[j]) == (plain[i] == plain[j]) for i in range(len(plain)) for j in range(i))
    small, quality.BLOCK = quality.BLOCK, 7
    try:
        again = quality.words_of(raw)
    finally:
        quality.BLOCK = small
    assert (again[0] == w).all() and (again[1] == f).all()
    index, value = quality.vector(raw, 12)
    assert np.isclose(value.sum(), 5) and (np.diff(index) > 0).all()


def test_edge_tables(spark):
    rows = corpus(60, 2)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(None, None), (900, None), (901, ""), (902, "a b " * 200_000), (1, rows[1][1])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1, 0), (1, 1), (2, None), (None, 1)], "doc_id long, quality int")
    out = quality.classify(docs, labels).collect()
    assert len(out) == len(rows) + 5 and all(r.score is not None for r in out)
    assert len({r.score for r in out if r.doc_id in (900, 901)}) == 1
    none = labels.limit(0)
    assert {r.score for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(docs.limit(0), labels).count() == 0


def plain_ftrl(rows, f, bias):
    """The updates coordinate by coordinate, with dictionaries; the bias isn't regularised."""
    z, n = {}, {}

    def weight(i):
        l1, l2 = (0.0, 0.0) if i == bias else (f.l1, f.l2)
        zi, ni = z.get(i, 0.0), n.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((f.beta + math.sqrt(ni)) / f.alpha + l2)

    for _ in range(f.epochs):
        for features, label in rows:
            w = {i: weight(i) for i in features}
            p = 1 / (1 + math.exp(-max(-35, min(35, sum(w[i] * x for i, x in features.items())))))
            for i, x in features.items():
                g = (p - label) * x
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / f.alpha * w[i]
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z}


def test_scores_are_those_of_plain_loops(spark):
    rows, bits, shards = corpus(90, 7), 14, 3
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    order = {r.doc_id: (r.o, r.s) for r in docs.select("doc_id", F.xxhash64("doc_id", F.lit("train")).alias("o")).withColumn("s", F.pmod(F.shiftrightunsigned("o", 32), F.lit(shards))).collect()}
    features = {i: {int(k): float(np.float32(v)) for k, v in zip(*quality.vector(t.encode(), bits))} for i, t, _ in rows}
    total, count = {}, 0
    for shard in range(shards):
        own = sorted((order[i][0], i, y) for i, _, y in rows if order[i][1] == shard and zlib.crc32(str(i).encode()) % 5)
        count += len(own)
        for k, w in plain_ftrl([(features[i], y) for _, i, y in own], quality.Ftrl(), 1 << bits).items():
            total[k] = total.get(k, 0.0) + len(own) * w
    got = {r.doc_id: r.score for r in quality.classify(docs, labels, bits=bits, shards=shards).collect()}
    for i, t, _ in rows:
        exact = dict(zip(*(a.tolist() for a in quality.vector(t.encode(), bits))))
        want = 1 / (1 + math.exp(-sum(total.get(k, 0.0) / count * v for k, v in exact.items())))
        assert abs(got[i] - want) < 1e-9
