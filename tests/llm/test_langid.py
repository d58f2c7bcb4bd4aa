import math
import os
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from helixlake.llm import langid
from helixlake.llm.queries import op12_language_id

SF = os.environ.get("HELIXLAKE_SF", "/root/testdata/sf0.01")


def corpus(n, seed, langs=("aa", "bb", "cc")):
    r = random.Random(seed)
    letters = {"aa": "etaoinsh", "bb": "etaoüßñk", "cc": "жщюэвабг"}
    words = {g: ["".join(r.choices(letters[g], k=r.randint(2, 7))) for _ in range(150)] for g in langs}
    return [(i, " ".join(r.choices(words[g], k=r.randint(8, 120))).capitalize() + ".", g) for i in range(n) for g in [r.choice(langs)]]


def test_held_out_accuracy_on_the_given_documents(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = op12_language_id(spark, SF).collect()
    assert len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 for r in out)
    assert len(held) > len(out) / 4 and np.mean([r.lang_pred == truth[r.doc_id] for r in held]) > 0.98
    assert np.mean([r.rejected for r in held]) < 0.05


def test_grams_are_those_of_words_with_their_spaces():
    def plain(text):
        clean = "".join(c if c.isalpha() else " " for c in text.lower())
        return [f" {w} "[i : i + n] for w in clean.split() for n in (1, 2, 3, 4) for i in range(len(w) + 3 - n) if f" {w} "[i : i + n] != " "]

    r = random.Random(4)
    for text in ["a", " a b ", "Don't stop", "ÀÉ  漢字。かな\n\n1 2x", "".join(r.choices("aB \n.éß", k=200))]:
        own = langid.signs(text)
        hashes = langid.grams(own)
        assert len(hashes) == len(plain(text)) and len(set(hashes.tolist())) == len(set(plain(text)))
        total, _ = langid.counts(text, 15)
        small, langid.BLOCK = langid.BLOCK, 40
        try:
            assert (langid.counts(text, 15)[0] == total).all()
        finally:
            langid.BLOCK = small


def test_scores_are_those_of_plain_loops(spark):
    rows = corpus(150, 5)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs, bits=12, clusters=3)
    learnt = [(t, g) for i, t, g in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    df = sum((langid.counts(t, 12)[0] > 0).astype(int) for t, _ in learnt)
    assert np.allclose(model.idf, [math.log((1 + len(learnt)) / (1 + n)) + 1 for n in df])
    assert set(model.langs) == {"aa", "bb", "cc"} and model.langs == sorted(model.langs) and len(model.langs) <= 9 and np.allclose((model.centroids**2).sum(axis=1), 1, atol=1e-5)
    out = {r.doc_id: r.language for r in langid.predict(docs, model).collect()}
    for i, t, g in rows:
        count = langid.counts(t, 12)[0]
        v = np.array([(1 + math.log(c)) * w if c else 0.0 for c, w in zip(count, model.idf)])
        cosines = model.centroids.astype(float) @ (v / math.sqrt((v * v).sum()))
        assert out[i].lang_pred == model.langs[cosines.argmax()] == g and abs(out[i].score - cosines.max()) < 1e-6


def test_other_languages_are_rejected_and_inputs_do_not_leak(spark):
    rows = corpus(240, 6, ("aa", "bb"))
    foreign = [(1000 + i, t, None) for i, (_, t, _) in enumerate(corpus(40, 7, ("cc",)))]
    schema = "doc_id long, text string, lang string"
    docs = spark.createDataFrame(rows + foreign, schema)
    out = {r.doc_id: r for r in langid.identify(docs).collect()}
    assert all(out[i].rejected and out[i].lang_pred in ("aa", "bb") for i, *_ in foreign)
    assert np.mean([out[i].rejected for i, *_ in rows]) < 0.05
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    lied = docs.withColumn("lang", F.when(held, F.lit("cc")).otherwise(F.col("lang")))
    assert {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(lied).collect()} == {i: (r.lang_pred, r.score) for i, r in out.items()}


def test_edge_tables(spark):
    rows = [(i, t, g, "s") for i, t, g in corpus(80, 8)] + [(None, None, "aa", "s"), (None, "taon", "zz", "s"), (900, None, None, "s"), (901, "", "aa", "s"), (902, "123 ?! 漢", None, "s"), (903, "12 34", "aa", "s"), (904, "etao insh " * 60_000, "aa", "s"), (904, "etao insh " * 60_000, "aa", "s"), (905, "x", None, "s")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, Score string")
    out = langid.identify(table).collect()
    assert len(out) == len(rows) and {r.lang_pred for r in out} == {"aa", "bb", "cc", "und"}
    assert sorted((r.doc_id for r in out if r.lang_pred == "und" and r.doc_id)) == [900, 901, 903]
    assert {(r.score, r.rejected) for r in out if r.lang_pred == "und"} == {(0.0, True)}
    assert langid.identify(table.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(table.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert langid.predict(table.withColumnRenamed("Score", "LANGUAGE"), langid.fit(table)).columns == ["doc_id", "text", "lang", "language"]


def test_few_texts_of_another_language_have_no_centroid():
    r = np.random.default_rng(2)
    unit = lambda x: x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    own, other = r.random((190, 40)) + np.r_[np.ones(20) * 4, np.zeros(20)], r.random((10, 40)) + np.r_[np.zeros(20), np.ones(20) * 4]
    x = unit(np.concatenate([own, other])).astype(np.float32)
    centres = langid.clustered(x, 4)
    assert 1 <= len(centres) <= 4 and np.allclose((centres**2).sum(axis=1), 1, atol=1e-5) and (centres @ unit(other.mean(axis=0)[None])[0] < 0.9).all()
    assert len(langid.clustered(x[:1], 4)) == 1
