"""Steps whose tables must not grow with more than their input."""

from pyspark.sql import functions as F

from helixlake.operators import cells, kinetics, literature, proteins


def _rows(df):
    return sorted(map(tuple, df.collect()))


def test_residues_stay_in_their_row_and_sites_are_those_of_the_join(spark):
    texts = [(i, ["a", "b", None][i % 3], t, c) for i, (t, c) in enumerate([("ACDEFGHIKLMNPQRSTVWY" * 5, [3, 40]), ("ACDxé𝔸FGH-KLM" * 9, [None, 7]), ("ACD", [1]), ("", [1]), (None, [1]), ("YYYY", None), ("A", []), ("ACDEFWWW" * 20, [])])]
    s = spark.createDataFrame(texts, "id long, family string, sequence string, catalytic array<long>")
    profile = proteins.profile(proteins.positions(s, ["family"]))
    assert "SortMergeJoin" not in (plan := proteins.top_sites(s, profile)._jdf.queryExecution().executedPlan().toString()) and "Exchange" not in plan
    want = _rows(proteins.best_sites(proteins.site_scores(s, profile)))
    assert _rows(proteins.best_sites(proteins.top_sites(s, profile))) == want and want
    assert _rows(proteins.best_sites(proteins.top_sites(s, profile, most=1))) == want


def test_resamples_are_numbered_without_lists_of_weights(spark):
    x = spark.range(200).select((F.col("id") % 2).alias("sample"), (F.col("id") % 20 + 1.0).alias("s"), (F.col("id") % 20 * 3.0 + F.col("id") % 7).alias("rate"))
    fits = kinetics.bootstrap_fit(x, resamples=5)
    assert fits.count() == 2
    assert "transform(" not in fits._jdf.queryExecution().optimizedPlan().toString()


def test_codons_of_odd_sequences(spark):
    s = spark.createDataFrame([(1, "MKÉ𝔸m"), (2, ""), (3, None), (4, "M"), (5, "")], "id long, seq string")
    got = {r["id"]: (r["dna"], r["cai"], r["gc"]) for r in cells.codon_optimised(s).collect()}
    assert got[1][0] == cells.CODONS["M"][0] + cells.CODONS["K"][0] + "N" * 9
    assert got[2] == got[3] == got[5] == ("", 0.0, 0.0) and got[4] == (cells.CODONS["M"][0], cells.CODONS["M"][1], 33.333)


def test_words_of_an_article_are_dealt_once_with_it(spark):
    a = spark.createDataFrame([(1, "Some Title", "alpha alpha bravo-two NADH"), (1, "Title", "alpha charlie"), (2, None, None)], "id long, title string, abstract string")
    k = literature.keywords(a, top=1)
    assert {tuple(r) for r in k.collect()} == {(1, "Some", "title"), (1, "Title", "title"), (1, "NADH", "acronym"), (1, "bravo-two", "hyphenated"), (1, "alpha", "frequent")}
    assert k._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1].count("Exchange") == 1


def test_only_asked_words_of_texts_are_written(spark, monkeypatch):
    written = []
    monkeypatch.setattr(literature, "cut", lambda df: written.append(df.count()) or df)
    q = spark.createDataFrame([(1, ["alpha"])], "query int, words array<string>")
    t = spark.createDataFrame([(i, "alpha " + " ".join(f"w{j}" for j in range(50))) for i in range(4)] + [(9, None)], "id int, text string")
    assert [tuple(r) for r in literature.evidence_for(q, t, 2).orderBy("rank").collect()] == [(1, 0, 1, 1), (1, 1, 1, 2)]
    assert max(written) <= 4
