"""Language identification by nearest centroids: normalised TF-IDF n-gram vectors, several centroids a language.

A text's features are the 1- to 4-grams of its lower-cased letters, runs of other signs being one
space, hashed into ``2**bits`` slots; a slot weighs 1 + ln(count) times its inverse document frequency, and a
vector has length 1. Document frequencies are counted over all documents that may be learnt from. The
documents of a language that are sampled to be learnt are clustered on the sphere (k-means by cosine) into
``clusters`` centroids, as one language is written in several ways. A text has the language of the centroid with the
largest cosine. It is ``rejected`` where that centroid is farther away than learnt texts of the language
and of about that length are: most likely, it is in none of the languages.
"""

from __future__ import annotations

import functools
import unicodedata
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

UNKNOWN = "und"
#: Orders of the n-grams.
ORDERS = (1, 2, 3, 4)
#: Code points of a text that are looked at together, so that a very long one needs bounded memory.
BLOCK = 1 << 18
#: Languages that a table may teach: each has a task and ``clusters`` vectors.
LANGUAGES = 256
#: A text is rejected where its cosine is under that of all but this share of the learnt texts of its length ...
REJECT = 0.002
#: ... less this.
SLACK = 0.05
#: Clusters of less than this share of a language's sampled documents teach nothing.
SHARE = 0.1
#: Lengths are told apart by powers of two of the number of letters and spaces.
BANDS = 24


class Model(NamedTuple):
    """``centroids`` has a row of ``2**bits`` for each of ``langs``; ``least`` is the least cosine by language and band of lengths."""

    bits: int
    idf: np.ndarray
    langs: list[str]
    centroids: np.ndarray
    least: dict[str, np.ndarray]


@functools.cache
def _lettered() -> np.ndarray:
    """Of every code point: is it a letter, or a mark that belongs to one?"""
    return np.fromiter((unicodedata.category(chr(i))[0] in "LM" for i in range(0x110000)), bool, 0x110000)


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def signs(text: str) -> np.ndarray:
    """Lower-cased letters as numbers, runs of anything else as one 32, with a 32 at either end."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    x = np.where(_lettered()[x], x, 32)
    keep = x != 32
    keep[1:] |= x[:-1] != 32
    keep[0] = True
    return x[keep].astype(np.uint64)


def grams(own: np.ndarray) -> np.ndarray:
    """Hashes of the n-grams of every word with the spaces around it; none goes over two words."""
    out, h = [], np.zeros(len(own), np.uint64)
    inner = np.zeros(len(own), bool)  # a space that isn't the n-gram's first or last sign
    space = own == 32
    for order in ORDERS:
        if len(own) < order:
            break
        n = len(own) - order + 1
        h = h[:n] * np.uint64(0x9E3779B97F4A7C15) + own[order - 1 :] + np.uint64(order)
        if order > 2:
            inner = inner[:n] | space[order - 2 : order - 2 + n]
        else:
            inner = space[:n] & space[order - 1 :]
        out.append(h[~inner])
        inner = inner if order > 2 else np.zeros(n, bool)
    return np.concatenate(out)


def counts(text: str, bits: int) -> tuple[np.ndarray, int]:
    """How often each slot occurs, and the number of letters and spaces. A word of over ``BLOCK`` letters may count as several."""
    total, n, at = np.zeros(1 << bits, np.int64), 0, 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text):
            end = max(text.rfind(" ", at + 1, end), text.rfind("\n", at + 1, end), -1)
            end = end if end > at else at + BLOCK
        own = signs(text[at:end])
        total += np.bincount((common.mix(grams(own)) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        n, at = n + len(own), end
    return total, n


def weighed(count: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slots of a text's vector and their weights; the vector has length 1, or no slot."""
    at = np.flatnonzero(count)
    w = (1 + np.log(count[at])) * idf[at]
    return at, w / np.sqrt(w @ w) if len(at) else w


def band(n: int) -> int:
    return min(BANDS - 1, int(n).bit_length())


def clustered(x: np.ndarray, clusters: int, share: float = SHARE) -> np.ndarray:
    """Centroids of length 1 by k-means with the cosine.

    Rows in clusters of less than ``share`` of all are left out and the rest is clustered again: texts under the wrong
    language, or with much of another one, are few, and would otherwise have centroids of their own.
    """
    while True:
        centres, at = _means(x, clusters)
        few = np.bincount(at, minlength=len(centres)) < share * len(x)
        if not few.any():
            return centres
        x = x[~few[at]]


def _means(x: np.ndarray, clusters: int, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Centroids, and the number of each row's; they start from the row nearest to the mean, and the farthest one each."""
    unit = lambda v: v / max(float(np.sqrt(v @ v)), 1e-30)
    chosen = [int((x @ unit(x.mean(axis=0))).argmax())]
    near = x @ x[chosen[0]]
    while len(chosen) < min(clusters, len(x)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, x @ x[chosen[-1]])
    centres = x[chosen].copy()
    for _ in range(rounds):
        at = (x @ centres.T).argmax(axis=1)
        for k in np.unique(at):
            centres[k] = unit(x[at == k].mean(axis=0))
    used = np.unique(at := (x @ centres.T).argmax(axis=1))
    return centres[used], np.searchsorted(used, at)


def least_cosines(cosines: np.ndarray, bands: np.ndarray, share: float = REJECT, slack: float = SLACK) -> np.ndarray:
    """By band of lengths, the cosine under which a text is rejected: 0 below the shortest learnt texts; a band without any has that of the one below."""
    out, last = np.zeros(BANDS), 0.0
    for b in range(BANDS):
        own = cosines[bands == b]
        last = max(0.0, float(np.quantile(own, share)) - slack) if len(own) else last
        out[b] = last
    return out


def held_out(doc_id: str) -> Column:
    """True for one id in three, by the CRC-32 of its decimal text; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def document_frequencies(texts: DataFrame, bits: int) -> np.ndarray:
    """In how many of all ``texts`` (text) each slot occurs; every task hands over its sums."""

    def count(frames):
        total = np.zeros(1 << bits, np.int64)
        for frame in frames:
            for x in frame.column(0):
                total += counts(x.as_py() or "", bits)[0] > 0
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["slot", "n"])

    out = np.zeros(1 << bits, np.int64)
    for r in texts.mapInArrow(count, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).toLocalIterator():  # 2**bits rows at most
        out[r.slot] = r.n
    return out


def fit(docs: DataFrame, *, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", rows: int = 800, clusters: int = 4, bits: int = 15) -> Model:
    """Learn from documents with a language that aren't held out.

    Document frequencies are those of all of them; centroids are clustered from about ``rows`` documents of each language, all
    if there are fewer, that a hash of the id and text selects. Rows with a null id, a null language or a text without a letter
    teach nothing. Without a row to learn from there is no language, and every text is ``UNKNOWN``.
    """
    own = docs.select(*(c.alias(n) for c, n in zip(common.quoted([doc_id, lang, text]), ("doc_id", "lang", "text"))))
    own = own.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out("doc_id")).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    known = own.groupBy("lang").agg(F.count("*").alias("n")).limit(LANGUAGES + 1).collect()
    if len(known) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    idf = np.log((1 + sum(r.n for r in known)) / (1 + document_frequencies(own.select("text"), bits))) + 1
    if not known:
        return Model(bits, idf, [], np.empty((0, 1 << bits), np.float32), {})
    order = F.xxhash64("doc_id", "text", F.lit("lang"))
    share = F.create_map(*(F.lit(v) for r in known for v in (r.lang, int(min(1.0, rows / r.n) * (1 << 30)))))
    chosen = own.where(F.pmod(order, F.lit(1 << 30)) < F.element_at(share, F.col("lang"))).select("lang", order.alias("order"), "text")
    sent = docs.sparkSession.sparkContext.broadcast(idf)  # 2**bits doubles, whatever the input

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("text", "ascending")])
        texts = [t for t in table["text"].to_pylist() if has_letter(t or "")]
        if not texts:
            return pa.table({"lang": pa.array([], pa.string()), "centroids": pa.array([], pa.list_(pa.binary())), "least": pa.array([], pa.list_(pa.float64()))})
        x, bands = np.zeros((len(texts), 1 << bits), np.float32), np.empty(len(texts), int)
        for i, t in enumerate(texts):
            count, n = counts(t, bits)
            at, w = weighed(count, sent.value)
            x[i, at], bands[i] = w, band(n)
        centres = clustered(x, clusters)
        least = least_cosines((x @ centres.T).max(axis=1), bands)
        return pa.table({"lang": table["lang"][:1], "centroids": pa.array([[c.astype("<f4").tobytes() for c in centres]]), "least": pa.array([least.tolist()])})

    found = sorted(chosen.groupBy("lang").applyInArrow(learn, "lang string, centroids array<binary>, least array<double>").collect(), key=lambda r: r.lang)  # a row a language
    langs = [r.lang for r in found for _ in r.centroids]
    centroids = np.array([np.frombuffer(c, "<f4") for r in found for c in r.centroids], np.float32).reshape(len(langs), 1 << bits)
    return Model(bits, idf, langs, centroids, {r.lang: np.array(r.least) for r in found})


def nearest(text: str | None, model: Model, by_slot: np.ndarray) -> tuple[str, float, bool]:
    """(language, cosine, rejected); ``by_slot`` is the transposed centroids."""
    if not text or not model.langs or not has_letter(text):
        return UNKNOWN, 0.0, True
    count, n = counts(text, model.bits)
    at, w = weighed(count, model.idf)
    cosines = w @ by_slot[at]
    best = int(cosines.argmax())
    score = min(1.0, max(0.0, float(cosines[best])))
    return model.langs[best], score, score < model.least[model.langs[best]][band(n)]


def predict(docs: DataFrame, model: Model, *, text: str = "text", into: str = "language") -> DataFrame:
    """All columns and ``into``: a struct of ``lang_pred``, ``score``, the cosine, and ``rejected``. One of that name is replaced."""
    sent = docs.sparkSession.sparkContext.broadcast((model, np.ascontiguousarray(model.centroids.T)))  # LANGUAGES x clusters x 2**bits numbers at most

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def of(texts: pa.Array) -> pa.Array:
        found = [nearest(t.as_py(), *sent.value) for t in texts]
        kinds = [pa.string(), pa.float64(), pa.bool_()]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in found], kind) for i, kind in enumerate(kinds)], names=["lang_pred", "score", "rejected"])

    base = docs.select(common.quoted(c for c in docs.columns if c.lower() != into.lower()))
    return base.withColumn(into, of(common.quoted([text])[0].cast("string")))


def identify(docs: DataFrame, *, lang: str = "lang", doc_id: str = "doc_id", text: str = "text", **params) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, rejected) for every row of ``docs``; no input of a prediction but the text.

    Null texts and those without a letter are ``UNKNOWN`` with score 0. Rejected texts still name the nearest language, for
    the caller to use or not. Null ids are predicted, never held out or learnt from; repeated rows are predicted each;
    whole texts of any length are read; of equally near centroids the first language in order wins. An empty
    table gives an empty one.
    """
    model = fit(docs, lang=lang, doc_id=doc_id, text=text, **params)
    own = docs.select(*(c.alias(n) for c, n in zip(common.quoted([doc_id, text]), ("doc_id", "text"))))
    return predict(own, model).select("doc_id", held_out("doc_id").alias("held_out"), "language.lang_pred", "language.score", "language.rejected")
