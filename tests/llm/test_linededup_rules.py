import os

import pytest

from helixlake.llm import linededup as ld
from helixlake.llm.queries import ORACLE, op5_line_dedup
from tests.llm.oracle import same

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001")


def left(spark, texts):
    return {r.doc_id: r.text for r in ld.dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


@pytest.mark.parametrize("line", ["{0} {1} {2} {3}", "x = a[{0}] + b[{1}]", "2024-01-{0} 10:{1} 3.{2} ok", "<*> {0} <*> {1}"])
def test_distinct_rows_of_numbers_stay(spark, line):
    texts = [line.format(i, i + 50, i * 7, i * i) for i in range(12)]
    assert left(spark, texts) == dict(enumerate(texts))


def test_the_same_row_of_numbers_goes(spark):
    texts = [f"1 2  3 4\n{i} {i} {i} {i}" for i in range(9)] + ["1 2 3 4\nend"]
    got = left(spark, texts)
    assert got == {0: texts[0], **{i: f"{i} {i} {i} {i}" for i in range(1, 9)}, 9: "end"}


def test_long_lines_recur_from_two_documents_on(spark):
    words = [f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60)]
    long, short, other = " ".join(words[:51]), " ".join(words[:50]), " ".join(words[:50][::-1] + ["7"])
    changed = " ".join([*words[:30], "else", *words[31:51]])
    texts = [f"a b c d e {i}\n{long}" for i in range(2)] + [f"{short}\n{long}\nend", short, other, other.replace("7", "8"), changed, f"x\n{long.replace(' ', '  ')}\n{long}", None]
    got = left(spark, texts)
    assert got == dict(enumerate(texts)) | {1: "a b c d e 1", 2: f"{short}\nend", 7: "x"}


def test_long_lines_of_numbers_go_only_as_exact_copies(spark):
    row = lambda i: " ".join(str(i * k) for k in range(60))
    texts = [row(i) for i in range(8)] + [row(3)]
    assert left(spark, texts) == dict(enumerate(texts)) | {8: ""}


@pytest.mark.parametrize("line", ["x", "Read more", "All rights reserved."])
def test_short_lines_recur_word_for_word(spark, line):
    texts = [f"{line}\ntext number {chr(97 + i)} is here" for i in range(5)] + [f"  {line} \nend", line + " not", "", None]
    got = left(spark, texts)
    assert got == dict(enumerate(texts)) | {i: f"text number {chr(97 + i)} is here" for i in range(1, 5)} | {5: "end"}
    assert left(spark, texts[1:5]) == dict(enumerate(texts[1:5]))


def test_columns_of_any_name_are_carried(spark):
    rows = [(i, "the same line in all of them", i, "a", "b", [i]) for i in range(6)]
    table = spark.createDataFrame(rows, "doc_id long, text string, _row int, row string, Lines string, _lines array<int>")
    got = sorted(ld.dedup(table, count="n_dropped").collect())
    assert [tuple(r)[2:] for r in got] == [(i, "a", "b", [i], int(i > 0)) for i in range(6)] and [r.text for r in got] == [rows[0][1]] + [""] * 5


def test_a_very_long_line_with_varying_tokens(spark):
    texts = [" ".join(["head", "of", "line", *(f"{chr(97 + i)}w{chr(97 + k % 26)}" for k in range(30_000))]) for i in range(6)]
    assert left(spark, texts) == dict(enumerate(texts))


def test_sql_agrees(spark):
    same(op5_line_dedup(spark, SF), ORACLE["op5_line_dedup"], {"documents": f"{SF}/documents.parquet"})
