"""Vector code compression: product quantisation in whole numbers, with a dictionary of values for every dimension.

A component becomes ``floor(scale * x)`` and a vector ``parts`` codes, each the number of its part's
nearest entry in that position's codebook. Vectors are kept in blocks; a block has, for every
dimension, the different whole numbers that occur in it and each vector's place among them. For a
codebook the squared differences of every different number to all entries are tabulated once, so the
distances of a part to all entries are rows of these tables, gathered by place and added up.

Codebooks grow from the first rows by rounds of assignment and mean. A round is one pass over the blocks:
every task adds up the parts of each entry and hands over one row an entry, and the driver sees the
codebooks alone, ``parts`` times ``entries`` rows whatever the input.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common, vectors

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Vectors of one block.
BLOCK = 4096
#: Whole numbers up to this size take part: their squares, summed over a part, stay exact.
LARGEST = 1 << 24
#: Vectors whose distances to all entries are held at once.
_SLICE = 1024


def codable(vector: str, parts: int = PARTS, scale: int = SCALE) -> F.Column:
    """No null, non-finite or huge component, and a length that ``parts`` divides."""
    fits = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < LARGEST / scale)
    v = F.col(vector)
    return F.coalesce((F.size(v) > 0) & (F.size(v) % parts == 0) & F.forall(v, fits), F.lit(False))


def finite(vector: str) -> F.Column:
    """Not null and without null or non-finite components."""
    return F.coalesce(F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    return np.floor(x.astype(float) * scale).astype(np.int64)


def dictionary(x: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each column of ``x`` its different values in order, and the place of every cell's value among them."""
    values, places = [], np.empty(x.shape[::-1], np.uint16)
    for d in range(x.shape[1]):
        own, places[d] = np.unique(x[:, d], return_inverse=True)
        values.append(own)
    return values, places


def distances(values: list[np.ndarray], places: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of the parts to all entries of ``book``: gathers from a table a dimension, added up."""
    largest = max(int(np.abs(book).max()), *(int(np.abs(v).max()) for v in values))
    kind = np.int32 if 4 * largest * largest * len(values) < 1 << 31 else np.int64
    total = np.zeros((places.shape[1], len(book)), kind)
    for own, place, entry in zip(values, places, book.T.astype(kind)):
        table = own.astype(kind)[:, None] - entry
        table *= table
        total += table[place]
    return total


def nearest(values: list[np.ndarray], places: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of every part's nearest entry, the smaller one on ties, and the squared distance."""
    at, far = [], []
    for i in range(0, places.shape[1], _SLICE):
        found = distances(values, places[:, i : i + _SLICE], book)
        at.append(found.argmin(axis=1))
        far.append(found[np.arange(len(found)), at[-1]].astype(np.int64))
    return np.concatenate(at), np.concatenate(far)


def blocks(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, label, values, sizes, places): ids, labels and dictionaries of up to ``BLOCK`` rows (vec_id, label, vector) each."""

    def pack(frames):
        held, n = [], 0

        def full():
            values, places = dictionary(np.concatenate([whole(vectors.matrix(part.column(2)), scale) for part in held]))
            own = [pa.concat_arrays([part.column(i) for part in held]) for i in (0, 1)]
            own = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in own]
            return pa.RecordBatch.from_arrays([*own, pa.array([np.concatenate(values).astype("<i4").tobytes()]), pa.array([[len(v) for v in values]], pa.list_(pa.int32())), pa.array([places.tobytes()])], names=["vec_id", "label", "values", "sizes", "places"])

        for frame in frames:
            at = 0
            while at < frame.num_rows:
                held.append(frame.slice(at, BLOCK - n))
                n, at = n + held[-1].num_rows, at + held[-1].num_rows
                if n == BLOCK:
                    yield full()
                    held, n = [], 0
        if n:
            yield full()

    lists = [T.StructField(c, T.ArrayType(rows.schema[c].dataType)) for c in ("vec_id", "label")]
    return rows.select("vec_id", "label", "vector").mapInArrow(pack, T.StructType([*lists, T.StructField("values", T.BinaryType()), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("places", T.BinaryType())]))


def _opened(frame: pa.RecordBatch, parts: int):
    """For each block of a batch, by part, the dictionaries and places."""
    for sizes, values, places in zip(frame.column("sizes"), frame.column("values"), frame.column("places")):
        sizes = sizes.values.to_numpy()
        values = np.split(np.frombuffer(values.as_buffer(), "<i4").astype(np.int64), np.cumsum(sizes)[:-1])
        places = np.frombuffer(places.as_buffer(), np.uint16).reshape(len(sizes), -1)
        width = len(sizes) // parts
        yield [(values[p * width : (p + 1) * width], places[p * width : (p + 1) * width]) for p in range(parts)]


def next_round(packed: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: every entry the floor of its parts' mean, entries without parts as they were."""
    sent = packed.sparkSession.sparkContext.broadcast(books)  # parts x entries x dimensions, whatever the input
    parts, entries, width = books.shape

    def add_up(frames):
        total, count = np.zeros((parts, entries, width), np.int64), np.zeros((parts, entries), np.int64)
        for frame in frames:
            for opened in _opened(frame, parts):
                for p, (values, places) in enumerate(opened):
                    at, _ = nearest(values, places, sent.value[p])
                    count[p] += np.bincount(at, minlength=entries)
                    order = np.argsort(at, kind="stable")
                    first = np.flatnonzero(np.diff(at[order], prepend=-1))
                    for d, (own, place) in enumerate(zip(values, places)):
                        total[p, at[order][first], d] += np.add.reduceat(own[place][order], first)
        p, e = np.nonzero(count)
        if len(p):
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(count[p, e]), pa.array(list(total[p, e]), pa.list_(pa.int64()))], names=["part", "entry", "n", "total"])

    sums = packed.select("values", "sizes", "places").mapInArrow(add_up, "part int, entry int, n bigint, total array<bigint>")
    each = sums.select("part", "entry", "n", F.posexplode("total").alias("at", "total")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    out = books.copy()
    for r in each.toLocalIterator():  # parts x entries x dimensions at most
        out[r.part, r.entry, r["at"]] = r.total // r.n
    return out


def first_entries(rows: DataFrame, parts: int = PARTS, entries: int = ENTRIES, scale: int = SCALE) -> np.ndarray:
    """Codebooks of the ``entries`` rows with the smallest ids, null ids last, equal ids by their vectors."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(entries).select("vector").collect()
    x = whole(np.array([r.vector for r in first], float), scale)
    return x.reshape(len(x), parts, -1).transpose(1, 0, 2)


def books_digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(packed: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): one byte a part, and the squared distances to the entries summed over the parts."""
    sent = packed.sparkSession.sparkContext.broadcast(books)
    parts = len(books)

    def code(frames):
        for frame in frames:
            for i, opened in enumerate(_opened(frame, parts)):
                found = [nearest(*own, book) for own, book in zip(opened, sent.value)]
                codes = np.stack([at for at, _ in found], axis=1).astype(np.uint8)
                own = [frame.column(c)[i].values for c in ("vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*own, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(sum(far for _, far in found))], names=["vec_id", "label", "code", "error"])

    own = [T.StructField(c, packed.schema[c].dataType.elementType) for c in ("vec_id", "label")]
    return packed.mapInArrow(code, T.StructType([*own, T.StructField("code", T.BinaryType()), T.StructField("error", T.LongType())]))


def compress(table: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for every row with a finite vector.

    ``code`` is a byte a part, ``label_error`` the sum of the errors of all rows with the same label, null
    labels being one. Vectors that are null or hold null or non-finite components are dropped. Every length of
    vectors has codebooks of its own; finite vectors whose length ``parts`` doesn't divide, or with a component
    of ``LARGEST / scale`` or more, can't be coded: their rows have a null code, error and digest. Fewer rows
    than ``entries`` make codebooks of so many entries. Rows that repeat an id are coded each; null ids come last
    among those the codebooks start from. An empty table gives an empty one. At most 256 entries.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part: 1 to 256 entries")
    own = table.select(*(c.alias(n) for c, n in zip(common.quoted([vec_id, vector, label]), ("vec_id", "vector", "label")))).where(finite("vector"))
    able = codable("vector", parts, scale)
    done = own.where(~able).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256"))
    for same in vectors.tables_by_length(own.where(able), "vector"):
        books = first_entries(same, parts, entries, scale)
        packed = common.cut(blocks(same, scale))
        for _ in range(rounds):
            books = next_round(packed, books)
        done = done.union(encode(packed, books).withColumn("codebooks_sha256", F.lit(books_digest(books))))
    done = common.cut(done)
    # a table, so that the join may split a hot label
    sums = common.cut(done.groupBy("label").agg(F.sum("error").alias("label_error")))
    d, s = done.alias("d"), sums.alias("s")
    return d.join(s, F.col("d.label").eqNullSafe(F.col("s.label"))).select("d.vec_id", "d.code", "d.error", "s.label_error", "d.codebooks_sha256")
