import corpus_pipeline
from helixlake.llm import linededup, nearcopies, quality
from tests.llm.test_quality import corpus


def test_columns_of_any_name_go_through_all_stages(spark, tmp_path):
    rows = [(i, t, 7, "r", 9, "dot", "tick", "space", [i]) for i, t, _ in corpus(60, 5)]
    table = spark.createDataFrame(rows, "doc_id long, text string, SCORE long, Row string, N_Dropped int, `a.b` string, `a``b` string, `a b` string, Lines array<int>")
    spark.createDataFrame([(i, y, 0) for i, _, y in corpus(60, 5)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == table.columns and docs.dtypes == table.dtypes, name
        assert {tuple(r)[2:8] for r in docs.collect()} == {(7, "r", 9, "dot", "tick", "space")}, name
        assert all(list(r)[8] == [r.doc_id] for r in docs.collect()), name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count()


def test_named_columns_replace_those_of_another_case(spark):
    table = spark.createDataFrame([(1, "one", 5, 6)], "doc_id long, text string, SCORE long, N_Dropped int")
    model = quality.fit(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert quality.score(table, model).columns == ["doc_id", "text", "N_Dropped", "score"]
    assert linededup.dedup(table, count="n_dropped").columns == ["doc_id", "text", "SCORE", "n_dropped"]
    assert nearcopies.keep_one(table).first()["SCORE"] == 5
