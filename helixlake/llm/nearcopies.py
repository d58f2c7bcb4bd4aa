"""SimHash near-dedup of texts at a similarity: wide fingerprints, pigeonring filtering, exact check.

Two texts are near copies where their sets of five-word shingles have a Jaccard similarity of 0.8 or
more. Sets at 0.8 differ in 15 % of their SimHash bits, about ten of 64, and a key of 64 bits can't
promise to find that. So the fingerprint is a ring of ``RING`` segments of ``SEGMENT`` bits. A pair is
a candidate where its sets' sizes may be similar, where it agrees on a whole segment and where the
chains of two and three segments that start there stay within their share of the whole budget, ``TAU``
of all bits; then the whole distance must stay within ``TAU``, and the sets themselves decide. By the pigeonring, some start has all its
chains within budget; that its first segment agrees in full is more than it promises, and is what a
pair may miss: of 1,500 pairs each it missed 0.013 at 0.80, 0.003 at 0.82 and 0.0007 at 0.85.

In a bucket all members meet its smallest one, the pivot. Those that are near copies of it are
connected, so only pairs across what is connected so far are compared after that, by their whole
fingerprints at once: the components are the same as if all pairs of all buckets had been compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common
from helixlake.llm.simhash import LOWER

SHINGLE = 5
#: Similarity from which texts are near copies, as a fraction of whole numbers.
SIMILAR = (4, 5)
#: Segments of the ring, and their bits.
RING, SEGMENT = 166, 22
#: Sizes of sets are put into bands, each up to BAND times the one before: four steps of what sizes of similar sets differ by.
BAND, MOST_BANDS = (SIMILAR[1] / SIMILAR[0]) ** 4, 16
#: Bits for a set's size beside two segments; larger sizes are the largest of these.
SIZE_BITS = 19
#: Bits of 3,712 that may differ: 562 is the mean at 0.8, 21.8 the standard deviation.
TAU = 640
#: Sets of fewer shingles skip the check of the whole distance, which is wider for them than the sets' similarity says.
FEW = 12
_WORDS = -(-RING * SEGMENT // 64)
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, _WORDS, np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(raw: bytes, shingle: int = SHINGLE) -> tuple[bytes, np.ndarray]:
    """A 128-bit digest of all words, and the distinct hashes of the shingles in order; texts with fewer words are one shingle."""
    import xxhash

    words = raw.translate(LOWER).split()
    if not words:
        return b"", np.empty(0, np.uint64)
    joined = b" ".join(words)
    data = np.frombuffer(joined, np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    first, last = starts[: max(1, len(words) - shingle + 1)], ends[min(shingle, len(words)) - 1 :]
    return xxhash.xxh3_128_digest(joined), np.unique(common.span_hashes(data, first, last))


def _majority(rows: np.ndarray) -> np.ndarray:
    """Per bit of the 64-bit columns of ``rows``: is it set in over half of them? Counts are kept bit-sliced, by carry-save adders."""
    wanted, level, planes = len(rows) // 2 + 1, [rows], []
    while level:
        carries = []
        x = np.concatenate(level) if len(level) > 1 else level[0]
        while len(x) > 2:
            third = len(x) // 3
            a, b, c = x[:third], x[third : 2 * third], x[2 * third : 3 * third]
            odd = a ^ b
            carries.append(a & b | c & odd)
            x = np.concatenate([odd ^ c, x[3 * third :]])
        if len(x) == 2:
            carries.append((x[0] & x[1])[None])
            x = (x[0] ^ x[1])[None]
        planes.append(x[0])
        level = carries
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for i in range(max(len(planes), wanted.bit_length()) - 1, -1, -1):
        have = planes[i] if i < len(planes) else np.zeros_like(more)
        if wanted >> i & 1:
            same &= have
        else:
            more |= same & have
            same &= ~have
    return more | same


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """SimHash of a set of shingle hashes, as 64-bit words."""
    out = None
    for at in range(0, max(len(hashes), 1), 1 << 17):
        x = hashes[at : at + (1 << 17), None] * _FACTORS
        x ^= x >> np.uint64(32)
        if len(hashes) <= 1 << 17:
            return _majority(x)
        bits = np.unpackbits(x.view(np.uint8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        out = bits if out is None else out + bits
    return np.packbits(out * 2 > len(hashes), bitorder="little").view(np.uint64)


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(row, doc_id, text): ``row`` stands for all columns of a row, because ids may be null or repeat."""
    return docs.select(common.row_key(*docs.columns).alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))


def sketches(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(row, doc_id, words, n, fp): the digest of the row's words, its number of shingles, its fingerprint."""
    own = _rows(docs, doc_id, text)

    def scan(frames):
        for frame in frames:
            words, sizes, fps = [], [], []
            for x in frame.column(2):
                digest, hashes = shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)
                words.append(digest)
                sizes.append(len(hashes))
                fps.append(fingerprint(hashes).view(np.int64) if len(hashes) else np.empty(0, np.int64))
            yield pa.RecordBatch.from_arrays([frame.column(0), frame.column(1), pa.array(words, pa.binary()), pa.array(sizes, pa.int32()), pa.array(fps, pa.list_(pa.int64()))], names=["row", "doc_id", "words", "n", "fp"])

    return own.mapInArrow(scan, T.StructType([*own.schema.fields[:2], T.StructField("words", T.BinaryType()), T.StructField("n", T.IntegerType()), T.StructField("fp", T.ArrayType(T.LongType()))]))


def size_bands(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The band of every size, and that of the largest size that may still be similar to it: the same or the next.

    Of two sets that may be similar, the larger one's band is one of the smaller one's two.
    """
    band = lambda x: np.minimum(np.log(x) / np.log(BAND), MOST_BANDS - 1).astype(np.int64)
    n = np.maximum(n, 1).astype(float)
    return band(n), band(n * (SIMILAR[1] / SIMILAR[0]) * (1 + 1e-9))


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every start in the ring, a key of its number and its segment, and the two segments that follow in one number."""
    bits = np.unpackbits(fps.view(np.uint8), axis=1, bitorder="little")[:, : RING * SEGMENT].reshape(-1, SEGMENT)
    values = (bits.astype(np.float32) @ (2.0 ** np.arange(SEGMENT, dtype=np.float32))).astype(np.int64).reshape(len(fps), RING)
    key = values | np.arange(RING) << SEGMENT
    return key, np.roll(values, -1, axis=1) << SEGMENT | np.roll(values, -2, axis=1)


def _segments(classes: DataFrame) -> DataFrame:
    """(key, after, id) per class and start, for each of the one or two bands in which similar sizes lie."""

    def expand(frames):
        for frame in frames:
            for at in range(0, frame.num_rows, 512):
                part = frame.slice(at, 512)
                ids, fps = part.column(0).to_numpy(), part.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, _WORDS)
                key, after = segment_keys(fps)
                own, upper = size_bands(part.column(1).to_numpy())
                both = np.concatenate([np.arange(len(ids)), np.flatnonzero(upper > own)])
                band = np.concatenate([own, upper[upper > own]])
                after = after << SIZE_BITS | np.minimum(part.column(1).to_numpy().astype(np.int64), (1 << SIZE_BITS) - 1)[:, None]
                key = key[both] | (band << (RING.bit_length() + SEGMENT))[:, None]
                yield pa.RecordBatch.from_arrays([pa.array(key.ravel()), pa.array(after[both].ravel()), pa.array(np.repeat(ids[both], RING))], names=["key", "after", "id"])

    return classes.select("id", "n", "fp").mapInArrow(expand, "key long, after long, id long")


def _size(after: Column) -> Column:
    return after.bitwiseAND(F.lit((1 << SIZE_BITS) - 1))


def _chains(x: Column, y: Column) -> Column:
    """The sizes may be similar, and chains of two and three segments from an equal one stay within their share of the budget."""
    ok, differs = _may(_size(x), _size(y)), F.shiftright(x.bitwiseXOR(y), SIZE_BITS)
    for length in (2, 3):
        ok = ok & (F.bit_count(F.shiftright(differs, SEGMENT * (3 - length))) <= length * TAU // RING)
    return ok


def _may(n: Column, m: Column) -> Column:
    """Sets of these sizes can be similar enough."""
    return F.least(n, m) * SIMILAR[1] >= F.greatest(n, m) * SIMILAR[0]


def _close(n: Column, m: Column, x: Column, y: Column) -> Column:
    """The whole distance is within the budget; very small sets always pass."""
    distance = F.lit(0)
    for i in range(_WORDS):
        distance = distance + F.bit_count(x[i].bitwiseXOR(y[i]))
    return (F.least(n, m) < FEW) | (distance <= TAU)


def _alike(x: Column, y: Column) -> Column:
    """The two sets of shingles are similar enough."""
    part, whole = SIMILAR
    return F.size(F.array_intersect(x, y)) * (part + whole) >= (F.size(x) + F.size(y)) * part


def shingle_sets(docs: DataFrame, classes: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, hashes) of the ``classes`` (id, row), from the text of the row that stands for each."""
    own = _rows(docs, doc_id, text).select("row", "text").join(classes, "row").select("id", "text")

    def scan(frames):
        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                part = frame.slice(at, 256)
                sets = [shingles(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle)[1].view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["id", "hashes"])

    return own.mapInArrow(scan, "id long, hashes array<long>").dropDuplicates(["id"])  # rows that are equal in all columns


def verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, **names) -> DataFrame:
    """Of candidate pairs (a, b) those that are near copies: by the whole distance, then by their sets."""
    side = lambda i, f: classes.select(F.col("id").alias(i), F.col("n").alias(f"n{i}"), F.col("fp").alias(f))
    met = pairs.join(side("a", "x"), "a").join(side("b", "y"), "b")
    near = common.settled(met.where(_may(F.col("na"), F.col("nb")) & _close(F.col("na"), F.col("nb"), F.col("x"), F.col("y"))).select("a", "b"))
    named = near.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    sets = common.settled(shingle_sets(docs, classes.join(named, "id", "left_semi").select("id", "row"), **names), 10_000)
    left, right = sets.select(F.col("id").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("id").alias("b"), F.col("hashes").alias("y"))
    return common.settled(near.join(left, "a").join(right, "b").where(_alike(F.col("x"), F.col("y"))).select("a", "b"))


def components(docs: DataFrame, classes: DataFrame, **names) -> DataFrame:
    """(node, component) of the ``classes`` (id, row, n, fp) that have near copies."""
    every = _segments(classes)
    several = every.groupBy("key").agg(F.count("*").alias("members")).where("members > 1").select("key")
    rows = common.cut(every.join(several, "key", "left_semi"))  # so that the joins below may split a hot bucket
    pivots = common.cut(rows.groupBy("key").agg(F.min(F.struct("id", "after")).alias("pivot"), F.count("*").alias("members")))
    met = rows.join(pivots, "key")
    stars = met.where((F.col("id") != F.col("pivot.id")) & _chains(F.col("after"), F.col("pivot.after"))).select(F.col("pivot.id").alias("a"), F.col("id").alias("b"))
    links = verified(stars.distinct(), classes, docs, **names)
    own = common.settled(common.components(links))
    label = lambda t, i, to: t.join(own, F.col(i) == own.node, "left").withColumn(to, F.coalesce("component", i)).drop("node", "component")
    # a bucket of two is its pivot and one more, which have met
    homes = common.cut(label(pivots.where("members > 2").select("key", F.col("pivot.id").alias("first")), "first", "home").select("key", "home"))
    rows = common.cut(label(rows.join(homes, "key"), "id", "own").withColumnRenamed("own", "component").withColumn("home", F.col("component") == F.col("home")))
    open_ = common.cut(rows.where("NOT home").select("key").distinct())  # most buckets hold no other component
    whole = rows.join(open_, "key", "left_semi").join(classes.select("id", "fp"), "id")
    x, y = whole.where("NOT home").alias("x"), whole.alias("y")  # members of the pivot's component meet the others only
    apart = (F.col("x.key") == F.col("y.key")) & (F.col("x.component") != F.col("y.component")) & (F.col("y.home") | (F.col("x.id") < F.col("y.id")))
    near = _chains(F.col("x.after"), F.col("y.after")) & _close(_size(F.col("x.after")), _size(F.col("y.after")), F.col("x.fp"), F.col("y.fp"))
    more = x.join(y, apart & near).select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()
    return common.components(links.union(verified(more, classes, docs, **names)))


def keep_one(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of every group of near copies, all columns; groups are what near copies connect.

    The row with the smallest id stays, rows without an id coming last; of rows that share it, the one
    with the smallest digest. Null and wordless texts are copies of each other. Texts with the same
    words meet once. Rows that are equal in all columns are one; different rows of one id are not.
    An empty table gives an empty one, and columns of any name are carried.
    """
    found = common.cut(sketches(docs, doc_id=doc_id, text=text))
    classes = found.where("n > 0").groupBy("words").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"))
    classes = common.cut(classes.withColumn("id", F.monotonically_increasing_id()))  # ids hold once they are written
    linked = components(docs, classes, doc_id=doc_id, text=text)
    of = classes.select("words", "id").join(linked, F.col("id") == F.col("node")).select("words", F.col("component").cast("string").alias("component"))
    named = found.join(of, "words", "left").select("row", "doc_id", F.coalesce("component", F.hex("words")).alias("component"))
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "row")
    kept = common.cut(named.groupBy("component").agg(F.min(place).alias("first")).select(F.col("first.row").alias("row")))
    key = common.free_name("row", docs.columns)
    keyed = docs.withColumn(key, common.row_key(*docs.columns))
    return keyed.join(kept.withColumnRenamed("row", key), key, "left_semi").dropDuplicates([key]).select(common.quoted(docs.columns))
