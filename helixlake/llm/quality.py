"""Quality classifier: hashed word n-gram logistic regression, trained with follow-the-regularised-leader updates.

Features of a text, each hashed into ``2**bits`` slots: words, pairs of words, word forms and pairs of
word forms. A form is the word with runs of upper case, lower case, digits and other signs collapsed
to one letter each, or a mark of its own where the word repeats the one before; forms carry over to
words never seen. Each of the four kinds has total weight 1, so long and short texts compare.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

#: Words are hashed in blocks of about this many bytes, so that a very long text needs bounded memory.
BLOCK = 1 << 18
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_FORM = np.full(256, ord("s"), np.uint8)
_FORM[65:91], _FORM[97:123], _FORM[128:], _FORM[48:58] = ord("U"), ord("l"), ord("l"), ord("d")


class Model(NamedTuple):
    """``weights`` has ``2**bits`` slots and the bias behind them."""

    bits: int
    weights: np.ndarray


class Ftrl(NamedTuple):
    """Parameters of the per-coordinate updates; ``epochs`` passes over the training rows of a shard."""

    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 0.02
    l2: float = 0.1
    epochs: int = 4


def words_of(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of a UTF-8 text and of their forms."""
    data, at, words, forms = np.frombuffer(raw, np.uint8), 0, [], []
    while at < len(data):
        end = min(len(data), at + BLOCK)
        while end < len(data) and not _SPACE[data[end]]:
            end += 1
        block = data[at:end]
        at = end
        inside = np.concatenate([[False], ~_SPACE[block], [False]])
        edge = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edge[::2], edge[1::2]
        words.append(common.span_hashes(block, starts, ends))
        form = _FORM[block]
        head = inside[1:-1].copy()
        head[1:] &= (form[1:] != form[:-1]) | ~inside[1:-2]
        before = np.concatenate([[0], np.cumsum(head)])
        forms.append(common.span_hashes(form[head], before[starts], before[ends]))
    none = np.empty(0, np.uint64)
    w = np.concatenate(words) if words else none
    f = np.concatenate(forms) if forms else none
    if len(w) > 1:
        f[1:][w[1:] == w[:-1]] = np.uint64(0x5EED)
    return w, f


def slots(raw: bytes, bits: int) -> list[np.ndarray]:
    """Feature slots of a text by kind, repeats included."""
    w, f = words_of(raw)
    shift, pair = np.uint64(64 - bits), np.uint64(0xC2B2AE3D27D4EB4F)
    kinds = (w, w[:-1] * pair + w[1:], f + np.uint64(1), f[:-1] * pair + f[1:] + np.uint64(2))
    return [(common.mix(k) >> shift).astype(np.int64) for k in kinds]


def vector(raw: bytes, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The sparse feature vector, bias included: sorted slots and values."""
    kinds = [k for k in slots(raw, bits) if len(k)]
    at = np.concatenate([*kinds, [1 << bits]])
    value = np.concatenate([*(np.full(len(k), 1 / len(k)) for k in kinds), [1.0]])
    index, where = np.unique(at, return_inverse=True)
    return index, np.bincount(where, value)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-35.0, min(35.0, x))))


def fit_shard(rows: list[tuple[np.ndarray, np.ndarray, int]], bits: int, ftrl: Ftrl) -> np.ndarray:
    """Follow-the-regularised-leader over (slots, values, label) rows in the given order."""
    z, n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def leader(zi, ni, penalised):
        w = -(zi - np.sign(zi) * ftrl.l1 * penalised) / ((ftrl.beta + np.sqrt(ni)) / ftrl.alpha + ftrl.l2 * penalised)
        return np.where(np.abs(zi) <= ftrl.l1 * penalised, 0.0, w)

    for _ in range(ftrl.epochs):
        for index, value, label in rows:
            zi, ni = z[index], n[index]
            w = leader(zi, ni, index < 1 << bits)
            g = (sigmoid(float(w @ value)) - label) * value
            grown = ni + g * g
            z[index] = zi + g - (np.sqrt(grown) - np.sqrt(ni)) / ftrl.alpha * w
            n[index] = grown
    return leader(z, n, np.arange(len(z)) < 1 << bits)


def held_out(doc_id: str) -> Column:
    """True for one id in five, by the CRC-32 of its decimal text; such rows are never learnt from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", train_rows: int = 20_000, shards: int = 4, bits: int = 18, ftrl: Ftrl = Ftrl()) -> Model:
    """Fit on about ``train_rows`` labelled rows, all if there are fewer; held-out ids are left out.

    The sample is what a hash of the id selects, so it depends on neither order nor partitions. Each
    of ``shards`` models learns from its share of the sample, and their weights are averaged. Ids with
    a null label or contradicting ones are not learnt from; without labelled rows every score is 1/2.
    """
    own = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL").where(~held_out("doc_id"))
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    order = F.xxhash64("doc_id", F.lit("train"))
    n = own.count()
    share = min(1.0, train_rows / n) if n else 1.0
    own = own.where(F.pmod(order, F.lit(1 << 30)) < int(share * (1 << 30))).select("doc_id", "label")
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    # about train_rows rows of two numbers: the size of this side is a parameter, not the input's
    rows = texts.join(F.broadcast(own), "doc_id").select("label", order.alias("order"), F.pmod(F.shiftrightunsigned(order, 32), F.lit(shards)).alias("shard"), "text")

    def extract(frames):
        for frame in frames:
            vectors = [vector(x.as_buffer().to_pybytes() if x.is_valid else b"", bits) for x in frame.column(3)]
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), frame.column(2), pa.array([i.astype("<i4").tobytes() for i, _ in vectors]), pa.array([v.astype("<f4").tobytes() for _, v in vectors])], names=["label", "order", "shard", "slots", "vals"])

    def learn(table: pa.Table) -> pa.Table:
        table = table.sort_by([("order", "ascending"), ("slots", "ascending"), ("vals", "ascending")])
        data = [(np.frombuffer(i.as_buffer(), "<i4"), np.frombuffer(v.as_buffer(), "<f4").astype(float), y) for y, i, v in zip(table["label"].to_pylist(), table["slots"].combine_chunks(), table["vals"].combine_chunks())]
        return pa.table({"n": [len(data)], "weights": pa.array([fit_shard(data, bits, ftrl).astype("<f8").tobytes()])})

    vectors = rows.mapInArrow(extract, "label int, order long, shard long, slots binary, vals binary")
    parts = vectors.groupBy("shard").applyInArrow(learn, "n long, weights binary").toLocalIterator()  # one row for each of few shards
    total, weights = 0, np.zeros((1 << bits) + 1)
    for part in parts:
        total += part.n
        weights += part.n * np.frombuffer(part.weights, "<f8")
    return Model(bits, weights / max(total, 1))


def logit(raw: bytes, model: Model) -> float:
    """Sparse dot product of a whole text with the weights."""
    total = float(model.weights[-1])
    for kind in slots(raw, model.bits):
        if len(kind):
            total += float(model.weights[kind].sum()) / len(kind)
    return total


def score(docs: DataFrame, model: Model, *, text: str = "text", into: str = "score") -> DataFrame:
    """All columns and ``into``, the probability that the label is 1; null and empty texts get the bias's.

    A column already called ``into``, in whatever case, is replaced. An empty table gives an empty one.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model.weights)  # 2**bits + 1 doubles, whatever the input
    bits = model.bits
    base = docs.select(common.quoted(c for c in docs.columns if c.lower() != into.lower()))

    @F.pandas_udf(T.DoubleType())
    def of(texts):
        own = Model(bits, sent.value)
        return texts.map(lambda x: sigmoid(logit((x or "").encode(), own)))

    return base.withColumn(into, of(F.coalesce(F.col(text).cast("string"), F.lit(""))))


def classify(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``; no input of a score but the text.

    Null and empty texts get the bias's score, null ids are scored and never held out or learnt from,
    repeated rows are scored each, whole texts of any length are read. An empty table gives an empty one.
    """
    model = fit(docs, labels, label=label, doc_id=doc_id, text=text, **params)
    own = score(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), model)
    return own.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, *, label: str = "quality", doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **params) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, with all their columns, whatever their names."""
    model = fit(docs, labels, label=label, doc_id=doc_id, text=text, **params)
    into = common.free_name("score", docs.columns)
    return score(docs, model, text=text, into=into).where(F.col(into) >= threshold).select(common.quoted(docs.columns))
