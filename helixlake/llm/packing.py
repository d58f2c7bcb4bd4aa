"""Concatenate and cut: token streams into fixed windows by two-pass prefix sums.

Pass one encodes every document once and keeps, next to the ids, each document's place among the
tokens of its partition. The partition totals (one row per partition) become global offsets by a
prefix sum; pass two cuts at multiples of the window and writes a record per piece. A window that
lies across partitions is made of boundary records with the same ``sequence_id``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common

WINDOW = 1024
END = 0
#: Partition totals up to this many rows (16 bytes each) are broadcast, beyond it joined by a shuffle.
BROADCAST_PARTITIONS = 500_000


def token_table(docs: DataFrame, tokenizer: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", end: int = END) -> DataFrame:
    """Encode once: (part, doc_id, local_start, doc_tokens, ids), one row per input row, in the shared folder.

    ``ids`` are little-endian unsigned 16-bit (32-bit for vocabularies that need it) and end with ``end``.
    Null texts count as empty, so a document has one id at least; repeated rows are documents of their own.
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    out = pa.schema([("part", pa.int32()), ("doc_id", common.arrow_type(own, "doc_id")), ("local_start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(frames):
        encoding = common.fast_encoding(tokenizer, pattern)
        kind = id_type(encoding.n_vocab)
        part, at = common.partition_id(), 0

        def rows():
            nonlocal at
            for frame in frames:
                for key, value in zip(frame.column(0).to_pylist(), frame.column(1)):
                    ids = encoding.encode_to_numpy(value.as_py() or "", disallowed_special=())
                    raw = np.append(ids, np.uint32(end)).astype(kind).tobytes()
                    yield part, key, at, len(ids) + 1, raw
                    at += len(ids) + 1

        yield from common.batches(rows(), out, 4)

    schema = T.StructType([T.StructField("part", T.IntegerType()), own.schema["doc_id"], T.StructField("local_start", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())])
    return common.cut(own.mapInArrow(encode, schema))


def id_type(n_vocab: int) -> str:
    return "<u2" if n_vocab <= 1 << 16 else "<u4"


def with_offsets(tokens: DataFrame) -> DataFrame:
    """``global_start`` instead of ``part`` and ``local_start``: the second prefix sum, over the partition totals."""
    totals = tokens.groupBy("part").agg(F.sum("doc_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = common.cut(totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")))
    if starts.count() <= BROADCAST_PARTITIONS:
        starts = F.broadcast(starts)
    rest = [c for c in tokens.columns if c not in ("part", "local_start", "doc_tokens", "ids")]
    return tokens.join(starts, "part").select(*rest, "doc_tokens", (F.col("part_start") + F.col("local_start")).alias("global_start"), "ids")


def pieces(tokens: DataFrame, width: str = "<u2", window: int = WINDOW) -> DataFrame:
    """Pieces of a :func:`token_table`: (doc_id, start, length, doc_tokens, sequence_id, offset, ids).

    ``ids`` are little-endian unsigned 32-bit. Windows are full but for the very last one.
    """
    placed = with_offsets(tokens)
    out = pa.schema([("doc_id", common.arrow_type(placed, "doc_id")), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def slice_up(frames):
        def rows():
            for frame in frames:
                keys, counts, starts = (frame.column(i).to_pylist() for i in range(3))
                for key, n, first, raw in zip(keys, counts, starts, frame.column(3)):
                    ids = np.frombuffer(raw.as_buffer(), width).astype("<u4")
                    at = 0
                    while at < n:
                        sequence, offset = divmod(first + at, window)
                        length = min(window - offset, n - at)
                        yield key, at, length, n, sequence, offset, ids[at : at + length].tobytes()
                        at += length

        yield from common.batches(rows(), out, 6)

    schema = T.StructType([placed.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in out.names[1:6]), T.StructField("ids", T.BinaryType())])
    return placed.mapInArrow(slice_up, schema)


def pack(docs: DataFrame, tokenizer: str, pattern: str, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, end: int = END) -> DataFrame:
    """Pack a document table into windows of ``window`` tokens: the :func:`pieces` of its :func:`token_table`.

    Nulls: a null text is empty, a null id is carried. An empty table gives no pieces. Columns other
    than the two named ones aren't read, whatever they are called.
    """
    tokens = token_table(docs, tokenizer, pattern, doc_id=doc_id, text=text, end=end)
    return pieces(tokens, id_type(common.fast_encoding(tokenizer, pattern).n_vocab), window)


def windows(tokens: DataFrame, width: str = "<u2", window: int = WINDOW) -> DataFrame:
    """Window records (sequence_id, offset, ids): whole windows, and boundary records where one crosses partitions.

    A partition's documents are consecutive in the global order, so all but its first and last
    record are whole windows. ``ids`` keep the table's width.
    """
    placed = with_offsets(tokens)
    out = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])
    wide = np.dtype(width).itemsize

    def fill(frames):
        def rows():
            held, at = bytearray(), None
            for frame in frames:
                for first, raw in zip(frame.column(2).to_pylist(), frame.column(3)):
                    if at is None or at + len(held) // wide != first:
                        if held:
                            yield at // window, at % window, bytes(held)
                        held, at = bytearray(), first
                    held += raw.as_py()
                    used = 0
                    while len(held) - used >= (room := (window - at % window) * wide):
                        yield at // window, at % window, bytes(held[used : used + room])
                        used += room
                        at += room // wide
                    if used:
                        del held[:used]
            if held:
                yield at // window, at % window, bytes(held)

        yield from common.batches(rows(), out, 2)

    return placed.mapInArrow(fill, "sequence_id long, offset long, ids binary")


def sequences(records: DataFrame, window: int = WINDOW, wide: int = 2, pad: int = END) -> DataFrame:
    """Whole sequences (sequence_id, n_tokens, ids) out of window records; only boundary records are shuffled.

    The last sequence is padded with ``pad`` to the window unless its length is a power of two.
    """
    whole = F.length("ids") == window * wide
    parts = records.where(~whole).groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("r"))
    joined = parts.select("sequence_id", F.aggregate("r", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"])).alias("ids"))
    every = records.where(whole).select("sequence_id", "ids").union(joined)
    n = F.expr(f"length(ids) div {wide}")
    short = (n < window) & (n.bitwiseAND(n - 1) != 0)
    filled = F.expr(f"rpad(ids, {window * wide}, X'{int(pad).to_bytes(wide, 'little').hex()}')")
    return every.select("sequence_id", n.alias("n_tokens"), F.when(short, filled).otherwise(F.col("ids")).alias("ids"))
