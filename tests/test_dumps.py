import io
import json

import pytest

from helixlake.operators import adapters
from helixlake.sources import dumps


@pytest.mark.parametrize("size", [1, 2, 3, 7, 50, 1000])
def test_every_line_is_read_by_one_range(size):
    raw = b"one\n\ntwo two\nthree\n" + b"x" * 30 + b"\nlast"
    got = [line.strip() for at in range(0, len(raw), size) for line in dumps.lines(io.BytesIO(raw), at, min(at + size, len(raw)))]
    assert got == [b"one", b"two two", b"three", b"x" * 30, b"last"]


def test_ranges_filters_and_unknown_sources(spark, tmp_path):
    rows = [{"id": i, "title": "é" * i, "yearPublished": 2000 + i % 3, "authors": [{"name": "n"}, {}, 5]} for i in range(200)]
    (tmp_path / "a.json").write_text("\n".join(map(json.dumps, rows)) + "\nnull\n", encoding="utf-8")
    (tmp_path / "_skipped").write_text("{}")
    known = dumps.Registry(spark)
    own = known.read("core", f"file://{tmp_path}", range=500)
    assert own.rdd.getNumPartitions() > 10 and own.where("error IS NULL").count() == 200 and own.where("error = 'no record'").count() == 1
    assert own.where("id = 'core-7'").first().authors == ["n", "", ""]
    assert own.where("year IN ('2001', '2002') AND title <> ''").count() == sum(r["yearPublished"] > 2000 and r["title"] != "" for r in rows)
    assert known.available("idr") and not known.available("arxiv") and known.read("arxiv", "").first().error == 'Source "arxiv" has no reader.'


def test_equal_and_listed_values_are_filtered_while_reading(tmp_path):
    (tmp_path / "a.json").write_text("\n".join(json.dumps({"id": i, "yearPublished": 2000 + i % 3, "doi": "d" if i % 2 else ""}) for i in range(60)))
    reader = dumps.DumpReader("CORE", dumps.core, ["id", "year", "doi"], str(tmp_path), 100)
    rest = [dumps.EqualTo(("authors",), []), dumps.EqualTo(("a", "b"), 1)]
    assert list(reader.pushFilters([dumps.In(("year",), ("2000", "2001")), rest[0], dumps.EqualTo(("year",), "2001"), dumps.EqualTo(("doi",), "d"), rest[1]])) == rest
    got = [row for part in reader.partitions() for row in reader.read(part)]
    assert got == [(f"core-{i}", "2001", "d") for i in range(60) if i % 3 == 1 and i % 2]


def test_adapters_by_tool(spark):
    tasks = spark.createDataFrame([(1, "a", "{}"), (2, "b", "{}"), (3, "a", "bad"), (4, None, None)], "task long, tool string, input string")
    own = adapters.Adapters([adapters.Registration("a", lambda t: t.where("input = '{}'").selectExpr("task", "'1' AS result"), "A")])
    assert own.supported("a") and not own.supported("b") and own.get("b") is None and [r.label for r in own.list()] == ["A"]
    assert {r.task: (r.status, r.result, r.error) for r in own.run(tasks).collect()} == {1: ("done", "1", None), 2: ("error", None, 'Tool "b" has no adapter.'), 3: ("error", None, "no result"), 4: ("error", None, 'Tool "" has no adapter.')}
    assert adapters.Adapters([]).run(tasks).count() == 4
