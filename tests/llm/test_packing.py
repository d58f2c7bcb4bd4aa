import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixlake.llm import packing
from helixlake.llm.queries import pack_documents

PATH, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


def brute(texts):
    t = Tokenizer.from_file(PATH)
    t.encode_special_tokens = True
    return [t.encode(x or "", add_special_tokens=False).ids + [0] for x in texts]


def docs(spark):
    texts = ["plain text of words", None, "", "  two\n\nlines ", "naïve café ñandú 漢字 🙂", "<|endoftext|> x", "long words " * 9000, "plain text of words", "x"] * 7
    return texts, spark.createDataFrame([(i, x, "clash", 1) for i, x in enumerate(texts)], "doc_id long, text string, ids string, start int").repartition(5)


def test_every_id_is_in_one_piece_and_windows_are_gapless(spark):
    texts, table = docs(spark)
    ids = brute(texts)
    rows = pack_documents(table).collect()
    for i, own in enumerate(ids):
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(own) and 0 < r.length <= 1024
            assert r.ids_crc32 == zlib.crc32(np.array(own[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(own)
    at = 0
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.sequence_id * 1024 + r.offset == at
        at += r.length
    assert at == sum(map(len, ids))


def test_sequences_hold_the_pieces(spark):
    texts, table = docs(spark)
    tokens = packing.token_table(table, PATH, PATTERN)
    stream = {(r.sequence_id, r.offset): r.ids for r in packing.pieces(tokens).collect()}
    flat = np.frombuffer(b"".join(stream[k] for k in sorted(stream)), "<u4")
    got = packing.sequences(packing.windows(tokens)).orderBy("sequence_id").collect()
    assert [r.sequence_id for r in got] == list(range(-(-len(flat) // 1024)))
    for r in got:
        own = np.frombuffer(r.ids, "<u2")
        assert r.n_tokens == len(flat[r.sequence_id * 1024 : (r.sequence_id + 1) * 1024])
        assert (own[: r.n_tokens] == flat[r.sequence_id * 1024 :][: r.n_tokens]).all() and not own[r.n_tokens :].any()
        assert len(own) == 1024 or (r.n_tokens & (r.n_tokens - 1)) == 0


def test_empty_table_and_null_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert pack_documents(empty).count() == 0
    assert packing.sequences(packing.windows(packing.token_table(empty, PATH, PATTERN))).count() == 0
    one = pack_documents(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).withColumn("n", F.col("doc_tokens")).first()
    assert one.doc_id is None and one.n == 3
