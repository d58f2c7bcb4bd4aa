import hashlib
import os
import random
import re

import pytest

from helixlake.llm import fim
from helixlake.llm.queries import ORACLE, op11_fill_in_middle
from tests.llm.oracle import same

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001")
UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output) by the rules, one unit after the other."""
    text = text or ""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[8 * i : 8 * i + 8], 16) for i in range(4))
    units = UNIT.findall(text)
    a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return len(units), "plain", None, None, text
    if h4 % 100 < 80:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def odd_texts(n):
    r = random.Random(3)
    signs = " \t\n\x0b\x0c\r\x1c\x1f\x7f\x85\xa0éß漢🙂<PSM>ab"
    return ["".join(r.choices(signs, k=r.randint(0, 60))) for _ in range(n)]


@pytest.mark.parametrize("block", [1, 2, 3, fim.BLOCK])
def test_ends_are_those_of_the_pattern(monkeypatch, block):
    monkeypatch.setattr(fim, "BLOCK", block)
    for text in ["", " ", "a", " a", "a ", "1234567 ", "12345678", "1234567\n8", "x" * 8 + " " * 8, *odd_texts(400)]:
        raw, units = text.encode(), UNIT.findall(text)
        own = fim.Units(raw)
        assert own.n == len(units)
        assert [own.end(k) for k in range(own.n + 1)] == [len("".join(units[:k]).encode()) for k in range(own.n + 1)]
        assert fim.code_points(raw) == len(text)


def test_every_byte_is_marked_as_it_should():
    import numpy as np

    x = np.arange(256, dtype=np.uint8)
    for shift in range(8):
        marks = fim._spaces(np.roll(x, shift).view("<u8")).view(np.uint8)
        assert [int(b) for b in np.roll(x, shift)[marks == 128]] == sorted([9, 10, 11, 12, 13, 32], key=list(np.roll(x, shift)).index)
        assert set(marks) == {0, 128}


def test_forms_and_round_trip(spark):
    rows = [*enumerate(odd_texts(300)), (1000, None), (1001, ""), (1002, "a <P> b"), (1003, "<" * 9 + "P> <S"), (None, "null id here"), (None, "null id here"), (5, "repeated id")]
    rows += [(2000 + i, "very long é text\n " * 40_000) for i in range(4)]
    table = spark.createDataFrame([(i, t, 1, 2, "f", "x") for i, t in rows], "doc_id long, text string, n int, H1 int, form string, `a.b` string")
    out = fim.transform(table).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    got = sorted(((str(r.doc_id), r.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in out), key=repr)
    assert got == sorted(((str(i), t or "", *brute(i, t)) for i, t in rows), key=repr)
    assert all(r.back == r.text for r in out) and {r.form for r in out} == {"plain", "psm", "spm"}
    assert fim.transform(table.limit(0)).count() == 0


def test_sql_agrees(spark):
    same(op11_fill_in_middle(spark, SF), ORACLE["op11_fill_in_middle"], {"documents": f"{SF}/documents.parquet"})
