"""SimHash near-duplicates with pigeonring filtering.

Fingerprints are grouped first, so copies meet once. Distinct fingerprints x, y with at most 4
differing bits of 64, cut into a ring of five segments, have a start from which every chain of l
consecutive segments differs in at most 4*l/5 bits: the first segment not at all, two segments in
one bit, three in two, four in three. The first two budgets make the join keys: the start segment
whole, and the next one without one of its three parts (one bit can spoil only one part). That is
fifteen masks of 20 to 23 bits; the longer chains prune inside the join, then the full distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

SHINGLE = 4
DISTANCE = 4
SEED = 42
#: First bits of the ring's segments; the last one ends at 64.
RING = (0, 13, 26, 39, 52)
#: Lower-cases A-Z and nothing else.
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def fingerprint(raw: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash of UTF-8 bytes: a bit is set where over half of the shingles' XXH64 values have it."""
    import xxhash

    words = raw.translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, n = xxhash.xxh64_intdigest, len(starts)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 65536):
        h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts[at : at + 65536].tolist(), ends[at : at + 65536].tolist())), "<u8", min(65536, n - at))
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) with the fingerprint as a signed long; null and wordless texts have fingerprint zero."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))

    def scan(frames):
        for frame in frames:
            fps = np.fromiter((fingerprint(x.as_buffer().to_pybytes() if x.is_valid else b"", shingle, seed) for x in frame.column(1)), np.uint64, frame.num_rows)
            yield pa.RecordBatch.from_arrays([frame.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return own.mapInArrow(scan, T.StructType([own.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _bits(low: int, high: int) -> int:
    return (1 << high) - (1 << low)


def _segments() -> list[int]:
    return [_bits(low, high) for low, high in zip(RING, [*RING[1:], 64])]


def _masks() -> list[list[int]]:
    """Per start segment, the three masks of its join keys."""
    out, segments, edges = [], _segments(), [*RING, 64]
    for i in range(5):
        low, high = edges[(i + 1) % 5], edges[(i + 1) % 5 + 1]
        third = [low + (high - low) * k // 3 for k in range(4)]
        out.append([segments[i] | segments[(i + 1) % 5] & ~_bits(third[k], third[k + 1]) for k in range(3)])
    return out


def _differs(mask: int, x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y).bitwiseAND(F.lit(_signed(mask))))


def _chain(start: int, x: Column, y: Column) -> Column:
    """The budgets of the chains of three, four and five segments; keys hold the first two but for a part."""
    segments, mask, ok = _segments(), 0, F.lit(True)
    for length in range(1, 6):
        mask |= segments[(start + length - 1) % 5]
        if length > 1:
            ok = ok & (_differs(mask, x, y) <= DISTANCE * length // 5)
    return ok


def links(classes: DataFrame) -> DataFrame:
    """Links (a, b), a < b, among distinct fingerprints ``fp`` that connect all pairs within the distance.

    Members of a bucket within half the distance of its smallest one are within the distance of each
    other, so they get a star to it and not all their pairs; every other pair in the distance is a link.
    """
    masks = _masks()
    keys = F.array(*[F.struct(F.lit(i * 3 + k).alias("j"), F.col("fp").bitwiseAND(F.lit(_signed(masks[i][k]))).alias("key")) for i in range(5) for k in range(3)])
    rows = classes.select("fp", F.explode(keys).alias("k")).select("fp", "k.j", "k.key")
    bucket = Window.partitionBy("j", "key")
    rows = rows.withColumn("pivot", F.min("fp").over(bucket)).withColumn("n", F.count("*").over(bucket)).where("n > 1")
    rows = common.cut(rows.select("j", "key", "fp", "pivot", (F.bit_count(F.col("fp").bitwiseXOR(F.col("pivot"))) <= DISTANCE // 2).alias("close")))
    stars = rows.where("close AND fp <> pivot").select(F.col("pivot").alias("a"), F.col("fp").alias("b"))
    x, y = rows.alias("x"), rows.alias("y")
    fx, fy = F.col("x.fp"), F.col("y.fp")
    chain = F.lit(False)
    for i in range(5):
        chain = F.when(F.floor(F.col("x.j") / 3) == i, _chain(i, fx, fy)).otherwise(chain)
    first = F.lit(True)  # of the masks of one start, only the first that agrees makes the pair
    for i in range(5):
        for k in (1, 2):
            earlier = F.lit(False)
            for before in range(k):
                earlier = earlier | (_differs(masks[i][before], fx, fy) == 0)
            first = F.when(F.col("x.j") == i * 3 + k, ~earlier).otherwise(first)
    on = (F.col("x.j") == F.col("y.j")) & (F.col("x.key") == F.col("y.key")) & (fx < fy) & ~(F.col("x.close") & F.col("y.close")) & (F.bit_count(fx.bitwiseXOR(fy)) <= DISTANCE) & chain & first
    pairs = x.join(y, on).select(fx.alias("a"), fy.alias("b"))
    return stars.union(pairs).distinct()


def groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint, component_id) per row: the hex fingerprint and the smallest doc_id its links reach.

    Null texts count as empty, and empty texts link like any others. Rows with a null doc_id keep it
    and belong to the component of their fingerprint; they never name one unless no id does.
    Repeated rows are returned as often as they come. An empty table gives an empty one.
    """
    fps = common.cut(fingerprints(docs, doc_id=doc_id, text=text, shingle=shingle, seed=seed))
    classes = common.cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    found = common.components(links(classes))
    of = classes.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first_id", F.coalesce("component", "fp").alias("component"))
    least = of.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = common.cut(of.join(least, "component").select("fp", "component_id"))
    return fps.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
