"""Shapes of stored JSON: what is read of a value is worked out once."""

from pyspark.sql import functions as F

from helixlake.functions import shapes as s


def test_every_value_is_looked_at_once_however_deep_it_lies(spark):
    deep = s.Record({"id": s.Text(), "n": s.Number(0, 0)}, needs=("id",))
    for _ in range(3):
        deep = s.Record({"id": s.Text(), "in": deep, "more": s.List(s.Choice(("a", "b")))}, needs=("id", "in"))
    text = s.sanitised(F.col("v"), deep)._jc.toString()
    assert text.count("schema_of_variant") == 3 + 3 * 4  # a value of each field, one of each list's items, and the document
    row = spark.createDataFrame([('{"id": "x", "in": {"id": "y", "in": {"id": "z", "in": {"id": 1}}}, "more": ["a", "c", 1], "odd": 1}',)], "j string")
    found = row.select(s.sanitised(F.try_parse_json("j"), deep).alias("r")).first().r
    assert found["value"] is None and [tuple(d) for d in found["dropped"]] == [("$", "incomplete")]
    flat = s.Record({"id": s.Text(), "more": s.List(s.Choice(("a", "b"))), "by": s.Map(deep)}, needs=("id",))
    found = row.select(s.sanitised(F.try_parse_json("j"), flat).alias("r")).first().r
    assert found["value"]["more"] == ["a"] and found["value"]["by"] == {} and [tuple(d) for d in found["dropped"]] == [("$.more[1]", "value"), ("$.more[2]", "kind"), ("$.in", "unknown"), ("$.odd", "unknown")]


def test_dropped_fields_read_each_state_once(spark):
    import os

    from helixlake.plans import state

    df = state.dropped_fields(spark, os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001"))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parse_json") + plan.count("parseJson") == 1


def test_documents_are_read_in_columns_as_in_one_expression(spark):
    inner = s.Record({"id": s.Text(), "n": s.Number(0, 0), "by": s.Map(s.Whole({"k": s.Choice(("a", "b"))}), ("x", "y"))}, needs=("id",))
    shape = s.Record({"id": s.Text(filled=True), "one": inner, "kept": s.Record({"flag": s.Flag(), "s": s.Choice(("a", "b"), "b")}, always=True, absent={"s": "a"}), "all": s.List(inner), "words": s.List(s.Text())}, needs=("id",))
    docs = [
        '{"id": "x", "one": {"id": "y", "n": -2, "by": {"x": {"k": "a", "z": 1.0}, "y": {"k": 1}, "z": {}}, "odd": 1}, "kept": {"flag": "", "s": "c"}, "all": [{"id": "a", "by": null}, {"n": 1}, null, 3, {"id": "b", "n": 2.5, "more": []}], "words": ["v", null, 2]}',
        '{"id": "", "one": 1}', '{"id": "x", "one": null, "kept": [], "all": {}, "words": "v"}', '{"id": "x", "one": {"n": 1}, "kept": {"flag": [], "other": {}}, "all": [[]]}', "[]", "null", "no json", None, "{}",
    ]
    df = spark.createDataFrame(list(enumerate(docs)), "i int, j string")
    want = {r.i: r.s.asDict(True) for r in df.select("i", s.sanitised(F.try_parse_json("j"), shape).alias("s")).collect()}
    got = {r.i: r.asDict(True) for r in s.staged(df, F.try_parse_json("j"), shape, "i").select("i", F.when(F.col("ok"), F.col("value")).alias("value"), "dropped").collect()}
    assert len(got) == len(docs) and all(got[i]["value"] == want[i]["value"] and got[i]["dropped"] == want[i]["dropped"] for i in want)
    assert [x["id"] for x in got[0]["value"]["all"]] == ["a", "b"] and ("$.one.by.y", "incomplete") in [tuple(d.values()) for d in got[0]["dropped"]]


def test_clean_states_has_no_work_with_what_was_dropped(spark):
    import os

    from helixlake.plans import state

    plan = state.clean_states(spark, os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "incomplete" not in plan and "evidencePackets[" not in plan


def test_dropped_fields_has_no_work_with_values(spark):
    import os

    from helixlake.plans import state

    plan = state.dropped_fields(spark, os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.001"))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and "Synthetic Biology Program" not in plan
