import corpus_pipeline
from helixlake.llm import linededup, quality
from tests.llm.test_linededup import brute
from tests.llm.test_nearcopies import brute as groups_of
from tests.llm.test_packing import brute as ids_of
from tests.llm.test_quality import corpus


def test_stages_match_brute_force(spark, tmp_path):
    rows = [(i, t + ("\nthis notice stands in many documents" if i % 3 == 0 else "")) for i, t, _ in corpus(120, 5)]
    rows += [(1000 + i, rows[i][1]) for i in range(20)] + [(2000, ""), (2001, None)]
    labels = [(i, y) for i, _, y in corpus(120, 5)]
    spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, y, 0) for i, y in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, lab = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    good = {r.doc_id for r in quality.classify(docs, lab).collect() if r.predicted}
    left = [r for r in rows if r[0] in good]
    assert 0 < len(left) < len(rows)
    cut = brute(left, linededup.MIN_DOCS)
    left = [(i, cut[i, t][0]) for i, t in left]
    first = {min(group)[0] for group in groups_of([(i, t or "") for i, t in left])}
    left = [(i, t) for i, t in left if i in first]
    want = {i: len(x) for (i, _), x in zip(left, ids_of([t for _, t in left]))}
    assert {r.doc_id: r.doc_tokens for r in got} == want
    assert sum(r.length for r in got) == sum(want.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert got.count() == 0 and {"doc_id", "ids", "ids_crc32"} <= set(got.columns)
