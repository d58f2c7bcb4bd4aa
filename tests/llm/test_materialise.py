import zlib

import numpy as np

from helixlake.llm import materialise as m
from tests.llm.test_packing import PATH, PATTERN, brute


def test_the_permutation_is_one_and_has_an_inverse():
    for n in (1, 2, 3, 5, 64, 1000, 4097):
        slots = m.slot_of(np.arange(n), n, 5)
        assert sorted(slots.tolist()) == list(range(n))
        assert (m.sequence_at(slots, n, 5) == np.arange(n)).all()
    a, b = m.slot_of(np.arange(1000), 1000, 1), m.slot_of(np.arange(1000), 1000, 2)
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(1000), a)[0, 1]) < 0.15


def test_shards_hold_the_stream_in_training_order(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "BLOCK_IDS", 700)
    texts = ["plain text of words " * k for k in range(40)] + [None, "", "é漢🙂", "x" * 5000, "plain text of words "]
    table = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, ids string, shard int").repartition(6)
    to = f"file://{tmp_path}/out"
    index = m.write_shards(table, to, PATH, PATTERN, window=64, shard=10).orderBy("shard").collect()
    layout = m.layout_of(spark, to)
    total = sum(len(x) for x in brute(texts))
    n = -(-total // 64)
    assert layout["tokens"] == total and layout["sequences"] == n and sum(r.n_tokens for r in index) == total
    assert [r.shard for r in index] == list(range(-(-n // 10))) and sum(r.n_sequences for r in index) == n
    rows = m.read_shards(spark, to).collect()
    assert sorted(r.slot for r in rows) == list(range(n))
    stream = np.concatenate([np.frombuffer(r.ids, "<u2")[: r.n_tokens] for r in sorted(rows, key=lambda r: r.sequence_id)])
    pieces, own = np.split(stream, np.flatnonzero(stream == 0) + 1), brute(texts)
    assert sorted(tuple(p.tolist()) for p in pieces if len(p)) == sorted(map(tuple, own))
    by_slot = np.stack([np.frombuffer(r.ids, "<u2") for r in sorted(rows, key=lambda r: r.slot)])
    assert (m.read_slots(to, layout, 7, 16) == by_slot[7:23]).all() and (m.read_slots(to, layout, n - 3, 99) == by_slot[n - 3 :]).all()
    for r in index:
        assert zlib.crc32(open(r.path.removeprefix("file://"), "rb").read()) == r.crc32


def test_empty_table(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id long, text string")
    to = f"file://{tmp_path}/none"
    assert m.write_shards(empty, to, PATH, PATTERN).count() == 0
    assert m.read_shards(spark, to).count() == 0
    assert m.read_slots(to, m.layout_of(spark, to), 0, 5).shape == (0, 1024)
