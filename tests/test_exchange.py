"""Files that are written and read back."""

from pyspark.sql import functions as F

from helixlake.sources import exchange


def _rows(spark, n):
    parts = spark.range(n).select((F.col("id") % 2).alias("doc"), F.col("id").alias("place"), F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), F.lit("a & b").alias("name"), F.lit("SO:0000316").alias("role"), F.lit("d").alias("description"))
    acts = spark.range(1).select(F.lit(0).cast("long").alias("doc"), F.lit("i").alias("id"), F.lit("SBO:0000589").alias("type"), F.array(F.lit("p0"), F.lit("p2")).alias("participants"))
    return exchange.sbol_rows(parts, acts, "https://designs.example")


def test_a_design_is_one_document_and_is_parsed_once(spark, tmp_path):
    at = str(tmp_path / "designs")
    docs = exchange.sbol_documents(_rows(spark, 6))
    assert docs.count() == 2
    docs.write.text(at)
    spark.createDataFrame([("no document",)], "value string").write.mode("append").text(at)
    rows = exchange.read_sbol(spark, at)
    assert rows.count() == 8
    read = rows.where(F.col("`sbol:hasFeature`").isNotNull()).select(F.col("`sbol:displayId`"), F.col("`sbol:name`"))
    assert read._jdf.queryExecution().executedPlan().toString().count("from_xml(") == 1
    got = {tuple(r) for r in exchange.sbol_parts(rows).select("doc", "place", "id", "role", "name", "before").collect()}
    assert got == {(str(d), i, f"p{d + 2 * i}", "SO:0000316", "a & b", f"p{d + 2 * i + 2}" if i < 2 else None) for d in range(2) for i in range(3)}


def test_bundled_files_give_what_a_folder_of_files_gives(spark, tmp_path):
    texts = {"a": '{"$schema": "s",\n "cases": [{"caseId": "1", "title": "t"}, {"caseId": 2}]}', "b": "{", "c": "[]", "d": '{"cases": {}, "x": 1}'}
    for n, t in texts.items():
        (tmp_path / "folder" / n).mkdir(parents=True)
        (tmp_path / "folder" / n / f"{n}.json").write_text(t)
    spark.createDataFrame([(f"/{n}.json", t) for n, t in texts.items()], "file string, value string").coalesce(1).write.json(str(tmp_path / "bundle"))
    rows = lambda tables: [sorted(map(str, (tuple(r) for r in t.withColumn("file", F.regexp_extract("file", "([a-z])[.]json$", 1)).collect()))) for t in tables]
    cases, errors = rows(exchange.load_bundles(spark, str(tmp_path / "bundle")))
    assert [cases, errors] == rows(exchange.load_cases(spark, str(tmp_path / "folder"), "*.json"))
    assert len(cases) == 2 and len(errors) == 5
    assert len(list((tmp_path / "bundle").glob("part-*"))) == 1
