import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from helixlake.llm import common, simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall("[^\x20\x09-\x0d]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def brute_groups(ids, fps):
    root = list(range(len(fps)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 4:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    least = {}
    for i in range(len(fps)):
        least[find(i)] = min(least.get(find(i), ids[i]), ids[i])
    return [least[find(i)] for i in range(len(fps))]


def test_groups_match_brute_force(spark):
    r = random.Random(3)
    words = [f"w{i}é" for i in range(400)]
    texts = [None, "", " \t\n", "One", "one", "a b c", "A B C D", "a b c", "x " * 20000]
    for _ in range(60):
        own = [r.choice(words) for _ in range(r.randint(3, 120))]
        texts.append(" ".join(own))
        for _ in range(r.randint(0, 5)):
            copy = list(own)
            copy[r.randrange(len(copy))] = r.choice(words)
            texts.append("\n".join(copy).upper() if r.random() < 0.3 else " ".join(copy))
    ids = r.sample(range(10_000), len(texts))
    table = spark.createDataFrame([(i, t, "clash", 5) for i, t in zip(ids, texts)], "doc_id long, text string, fp string, component_id int")
    fps = [brute_fingerprint(t) for t in texts]
    want = {i: (f"{f:016x}", c) for i, f, c in zip(ids, fps, brute_groups(ids, fps))}
    got = {x.doc_id: (x.fingerprint, x.component_id) for x in simhash.groups(table).collect()}
    assert got == want


def test_links_connect_every_close_pair(spark):
    r = np.random.default_rng(5)
    centres = r.integers(0, 1 << 64, 40, np.uint64)
    fps = set(map(int, centres)) | {0, (1 << 64) - 1}
    for c in centres:
        for _ in range(12):
            x = int(c)
            for b in r.choice(64, r.integers(1, 8), replace=False):
                x ^= 1 << int(b)
            fps.add(x)
    fps = sorted(fps)
    table = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)),) for f in fps], "fp long")
    links = simhash.links(table).collect()
    unsigned = lambda v: v % (1 << 64)
    assert all((unsigned(x.a) ^ unsigned(x.b)).bit_count() <= 4 for x in links)
    own = {unsigned(x.node): x.component for x in common.components(simhash.links(table)).collect()}
    component = [own.get(f, f) for f in fps]
    want = brute_groups(list(range(len(fps))), fps)
    assert len(set(zip(component, want))) == len(set(component)) == len(set(want))


def test_edge_tables(spark):
    assert simhash.groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "same words in here"), (1, "same words in here"), (None, "same words in here"), (None, None), (7, None)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((x.doc_id or -1, x.component_id) for x in simhash.groups(table).collect()) == [(-1, 1), (-1, 7), (1, 1), (1, 1), (7, 7)]


def test_components_of_a_long_chain_and_a_hub(spark):
    chain = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1001 + i) for i in range(400)]
    table = spark.createDataFrame(chain + hub, "a long, b long").orderBy(F.rand(1))
    own = {r.node: r.component for r in common.components(table).collect()}
    assert all(own[i] == 0 for i in range(301)) and all(own[1000 + i] == 1000 for i in range(401))
