import hashlib
import random

import public_tokenizers as P
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixlake.llm import bpe

PATH = P.path("byte_bpe_multi_50k.tiktoken")
RANKS = bpe.load_ranks(PATH)
LIBRARY = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
CODEC = bpe.codec(PATH, P.PATTERN)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=200))
def test_any_text_encodes_as_the_library_does_and_comes_back(text):
    try:
        text.encode()
    except UnicodeEncodeError:
        return
    ids = CODEC.encode(text)
    assert ids.tolist() == LIBRARY.encode_ordinary(text)
    assert "".join(CODEC.decode_stream(ids, 1)) == text


def test_long_pieces_settle_within_a_window(monkeypatch):
    monkeypatch.setattr(bpe, "SETTLE", 24)
    r = random.Random(2)
    tokens = list(RANKS)
    for _ in range(300):
        piece = b"".join(r.choice(tokens) for _ in range(60))
        assert CODEC.pieces.transducer.encode(piece) == LIBRARY._core_bpe.encode_single_piece(piece)
    assert CODEC.pieces.transducer.encode(b"ab" * 20_000) == LIBRARY._core_bpe.encode_single_piece(b"ab" * 20_000)


def test_code_points_of_every_age_split_as_in_the_library():
    for c in [*range(0x500, 0x600), *range(0x880, 0x8A0), *range(0x16E80, 0x16F00), *range(0x1C, 0x21), 0x85, 0xA0, 0x2028, 0x3000]:
        text = f"a{chr(c)}b {chr(c)}1{chr(c)}  {chr(c)}.{chr(c)}"
        assert CODEC.encode(text).tolist() == LIBRARY.encode_ordinary(text), hex(c)


def test_the_state_machine_waits_for_whole_characters():
    raw = "aé漢🙂b".encode()
    assert list(bpe.decode_tokens(raw[i : i + 1] for i in range(len(raw)))) == list("aé漢🙂b")
    machine = bpe.Utf8()
    assert machine.feed(b"\xf0\x9f") == "" and machine.close() == "�" and machine.feed(b"\xffa") == "�a"


def test_table(spark):
    texts = ["some words", None, "", "é 漢字\n\n  x", "<|endoftext|>", "ab " * 120_000, "some words"]
    table = spark.createDataFrame([(i or None, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    rows = {r.doc_id or 0: r for r in bpe.encode(table, PATH, P.PATTERN).collect()}
    for i, t in enumerate(texts):
        assert rows[i].ids == LIBRARY.encode_ordinary(t or "") and rows[i].decoded == (t or "")
    again = bpe.decode(bpe.encode(table, PATH, P.PATTERN).select("ids", F.lit(1).alias("decoded")), PATH, P.PATTERN).collect()
    assert sorted(r.decoded for r in again) == sorted(t or "" for t in texts)
    assert bpe.encode(table.limit(0), PATH, P.PATTERN).count() == 0


def test_query_digests(spark, tmp_path):
    from helixlake.llm.queries import op9_byte_bpe

    spark.createDataFrame([(1, "naïve text"), (2, None)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    for r in op9_byte_bpe(spark, str(tmp_path)).collect():
        text = "naïve text" if r.doc_id == 1 else ""
        ids = LIBRARY.encode_ordinary(text)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
