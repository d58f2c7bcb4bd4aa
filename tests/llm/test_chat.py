import hashlib

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from helixlake.llm import chat

PATH = P.path("byte_bpe_50k.json")
TEMPLATE = chat.Template()
LIBRARY = Tokenizer.from_file(PATH)
LIBRARY.add_special_tokens(list(TEMPLATE.marks))
piece = st.one_of(st.text(max_size=8), st.sampled_from([*TEMPLATE.marks, *TEMPLATE.reserved, "\\", "<", "[", "<|", "<<", " ", "\n", "é🙂"])).filter(lambda x: all(not 0xD800 <= ord(c) < 0xE000 for c in x))
text = st.lists(piece, max_size=8).map("".join)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.just("assistant"), st.just("user"), text), text), max_size=5))
def test_rendering_is_reversible_and_masks_are_exact(turns):
    formatted, spans = chat.render(turns)
    assert chat.parse(formatted) == turns
    assert [chat.unescape(formatted[a:b]) for a, b in spans] == [t for _, t in turns]
    for control in TEMPLATE.reserved:
        assert control not in formatted
    ids, offsets = chat.encoder_for(PATH, P.PATTERN, TEMPLATE).encode(formatted)
    library = LIBRARY.encode(formatted, add_special_tokens=False)
    assert ids.tolist() == library.ids and offsets.tolist() == [list(o) for o in library.offsets]
    mask = chat.mask_of(offsets, [s for s, (r, _) in zip(spans, turns) if r == "assistant"])
    assert chat.learnt(formatted, offsets[:, 0], offsets[:, 1], mask) == "".join(t for r, t in turns if r == "assistant")


def test_table(spark):
    rows = [(1, 1, "assistant", "b\\"), (1, 0, "user", "a"), (2, 0, "user", None), (3, 0, None, "x"), (3, 0, None, "x"), (None, 5, "assistant", "<|end|>"), (4, None, "assistant", ""), (5, 0, "assistant", "long é " * 30_000)]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, formatted string").repartition(3)
    out = {r.conv_id: r for r in chat.format_conversations(table, PATH, P.PATTERN).collect()}
    back = {r.conv_id: r for r in chat.read_back(chat.format_conversations(table, PATH, P.PATTERN)).collect()}
    assert [tuple(t) for t in back[1].turns] == [("user", "a"), ("assistant", "b\\")] and back[1].learnt == "b\\"
    assert [tuple(t) for t in back[2].turns] == [("user", "")] and back[2].learnt == ""
    assert [tuple(t) for t in back[3].turns] == [("", "x"), ("", "x")]
    assert back[None].learnt == "<|end|>" and back[4].learnt == "" and back[5].learnt == "long é " * 30_000
    assert sum(out[1].loss_mask) == 1 or sum(out[1].loss_mask) == 2
    assert all(len(r.ids) == len(r.starts) == len(r.ends) == len(r.loss_mask) for r in out.values())
    assert chat.read_back(chat.format_conversations(table.limit(0), PATH, P.PATTERN)).count() == 0


def test_query(spark, tmp_path):
    from helixlake.llm.queries import ORACLE, op2_chat_formatting
    from tests.llm.oracle import same

    rows = [(1, 0, "user", "a <|end|> \\ [INST]"), (1, 1, "assistant", "é<s>"), (2, 0, "assistant", None), (1, 2, "assistant", "z")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = op2_chat_formatting(spark, str(tmp_path))
    assert {r.conv_id: r.loss_sha256 for r in got.collect()}[1] == hashlib.sha256("é<s>z".encode()).hexdigest()
    same(got, ORACLE["op2_chat_formatting"], {"conversations": f"{tmp_path}/conversations.parquet/*.parquet"})
