"""Token ids as binary shards in training order.

Sequences are windows of the packed token stream. A keyed Feistel permutation with cycle-walking gives
each of the n sequences its own slot below n, without a table and reversibly; slots are cut into ranges,
and every range is one shard of records of the same size, so that slot s lies at a known place of a known
file and a reader can stop and go on anywhere. The stream is kept, and travels, in compressed blocks.
"""

from __future__ import annotations

import json
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixlake.llm import common, packing

ROUNDS = 6
#: Sequences of a shard: 8 MB at 1024 ids of 16 bits.
SHARD = 4096
#: Ids of one block of the stream (under 256 KB at 16 bits, which the compressor does best), and bytes a task
#: gathers before it sends its blocks on.
BLOCK_IDS, GATHER = 120_000, 48 << 20
#: Compression of both kinds of block.
LEVEL = 7


def _mixed(right: np.ndarray, key: int, rnd: int, half: int) -> np.ndarray:
    h = common.mix((right + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) ^ common.mix(np.array([key + rnd * 0x51ED270B], np.uint64)))
    return common.mix(h) & np.uint64((1 << half) - 1)


def _feistel(x: np.ndarray, key: int, half: int, rounds: range) -> np.ndarray:
    low = np.uint64((1 << half) - 1)
    left, right = x >> np.uint64(half), x & low
    forward = rounds.step > 0
    for rnd in rounds:
        if forward:
            left, right = right, left ^ _mixed(right, key, rnd, half)
        else:
            left, right = right ^ _mixed(left, key, rnd, half), left
    return left << np.uint64(half) | right


def _walk(x: np.ndarray, n: int, key: int, rounds: range) -> np.ndarray:
    if n <= 1:
        return np.zeros(len(x), np.int64)
    half = max(1, ((n - 1).bit_length() + 1) // 2)
    out = _feistel(np.asarray(x).astype(np.uint64), key, half, rounds)
    while (high := np.flatnonzero(out >= n)).size:  # outside: on along the cycle until inside
        out[high] = _feistel(out[high], key, half, rounds)
    return out.astype(np.int64)


def slot_of(sequence_id: np.ndarray, n: int, key: int) -> np.ndarray:
    """The slot, below ``n``, of every sequence id below ``n``."""
    return _walk(sequence_id, n, key, range(ROUNDS))


def sequence_at(slot: np.ndarray, n: int, key: int) -> np.ndarray:
    """The inverse of :func:`slot_of`."""
    return _walk(slot, n, key, range(ROUNDS - 1, -1, -1))


def stream_table(docs: DataFrame, tokenizer: str, pattern: str, *, text: str = "text", end: int = packing.END) -> DataFrame:
    """The packed token stream in blocks: (part, local_start, doc_tokens, ids), the ids compressed, in the shared folder."""
    own = docs.select(F.col(text).cast("string").alias("text"))
    out = pa.schema([("part", pa.int32()), ("local_start", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])

    def encode(frames):
        import zstandard

        encoding, part, at = common.fast_encoding(tokenizer, pattern), common.partition_id(), 0
        kind, press = packing.id_type(encoding.n_vocab), zstandard.ZstdCompressor(LEVEL).compress

        def blocks():
            nonlocal at
            held, n = [], 0
            for frame in frames:
                for value in frame.column(0):
                    held.append(np.append(encoding.encode_to_numpy(value.as_py() or "", disallowed_special=()), np.uint32(end)).astype(kind))
                    n += len(held[-1])
                    if n >= BLOCK_IDS:
                        yield part, at, n, press(np.concatenate(held).tobytes())
                        held, n, at = [], 0, at + n
            if held:
                yield part, at, n, press(np.concatenate(held).tobytes())

        yield from common.batches(blocks(), out, 3)

    return common.cut(own.mapInArrow(encode, "part int, local_start long, doc_tokens long, ids binary"))


def _pieces_of(first: int, ids: np.ndarray, window: int):
    """(sequence, offset, ids) of a stretch of the stream."""
    at = 0
    while at < len(ids):
        sequence, offset = divmod(first + at, window)
        take = min(window - offset, len(ids) - at)
        yield sequence, offset, ids[at : at + take]
        at += take


def write_shards(docs: DataFrame, to: str, tokenizer: str, pattern: str, *, key: int = 20240229, text: str = "text", window: int = packing.WINDOW, shard: int = SHARD, end: int = packing.END) -> DataFrame:
    """Write ``to``/shard-NNNNNNNN.bin for all texts and return the index, one row per shard.

    Columns: shard, first_slot, n_sequences, n_tokens, crc32, path. A record is ``window`` little-endian ids
    of 16 bits (32 where the vocabulary needs it); only the stream's last sequence is short and filled
    up with ``end``. ``to``/layout.json has what a reader needs. Null texts are empty, all rows count,
    an empty table writes no shard. ``to`` is a URI all executors can write to; a shard is written
    under a name of its own and renamed when whole, so lost or repeated tasks do no harm.
    """
    spark = docs.sparkSession
    stream = stream_table(docs, tokenizer, pattern, text=text, end=end)
    kind = packing.id_type(common.fast_encoding(tokenizer, pattern).n_vocab)
    tokens = stream.agg(F.sum("doc_tokens")).first()[0] or 0
    n = -(-tokens // window)
    wide = np.dtype(kind).itemsize
    head = np.dtype([("slot", "<i8"), ("offset", "<i4"), ("length", "<i4")])

    def deal(frames):
        """Gather the pieces for each shard, and send them as one compressed block."""
        import zstandard

        press, unpress = zstandard.ZstdCompressor(LEVEL).compress, zstandard.ZstdDecompressor().decompress

        def blocks():
            heads, bodies, size = {}, {}, 0
            for frame in frames:
                for first, raw in zip(frame.column(1).to_pylist(), frame.column(2)):
                    pieces = list(_pieces_of(first, np.frombuffer(unpress(raw.as_py()), kind), window))
                    slots = slot_of(np.array([p[0] for p in pieces]), n, key).tolist()
                    for slot, (_, offset, ids) in zip(slots, pieces):
                        heads.setdefault(slot // shard, []).append((slot, offset, len(ids)))
                        bodies.setdefault(slot // shard, []).append(ids.tobytes())
                        size += ids.nbytes
                    if size >= GATHER:
                        yield from ((s, len(heads[s]), press(np.array(heads[s], head).tobytes() + b"".join(bodies[s]))) for s in heads)
                        heads, bodies, size = {}, {}, 0
            yield from ((s, len(heads[s]), press(np.array(heads[s], head).tobytes() + b"".join(bodies[s]))) for s in heads)

        yield from common.batches(blocks(), pa.schema([("shard", pa.int64()), ("n", pa.int64()), ("block", pa.binary())]), 2)

    def write(frames):
        """Fill one shard's buffer after the other; blocks arrive sorted by shard."""
        import zstandard
        from pyarrow import fs

        unpress = zstandard.ZstdDecompressor().decompress
        store, root = fs.FileSystem.from_uri(to)

        def rows():
            at, buffer, count = None, None, 0
            for frame in frames:
                for number, pieces, block in zip(*(c.to_pylist() for c in frame.columns)):
                    if number != at:
                        if at is not None:
                            yield close(at, buffer, count)
                        at, count = number, 0
                        buffer = np.full(min(shard, n - number * shard) * window, end, kind)
                    raw = unpress(block)
                    heads, ids, used = np.frombuffer(raw, head, pieces), np.frombuffer(raw, kind, offset=pieces * head.itemsize), 0
                    for slot, offset, length in heads.tolist():
                        place = (slot - at * shard) * window + offset
                        buffer[place : place + length] = ids[used : used + length]
                        used += length
                    count += used
            if at is not None:
                yield close(at, buffer, count)

        def close(number, buffer, count):
            path = f"{root}/shard-{number:08d}.bin"
            mine = f"{root}/.{number:08d}-{common.partition_id()}-{np.random.default_rng().integers(1 << 62)}"
            raw = buffer.tobytes()
            with store.open_output_stream(mine) as f:
                f.write(raw)
            store.move(mine, path)
            return number, number * shard, len(buffer) // window, count, zlib.crc32(raw), f"{to}/shard-{number:08d}.bin"

        store.create_dir(root, recursive=True)
        yield from common.batches(rows(), pa.schema([("shard", pa.int64()), ("first_slot", pa.int64()), ("n_sequences", pa.int64()), ("n_tokens", pa.int64()), ("crc32", pa.int64()), ("path", pa.string())]))

    placed = packing.with_offsets(stream)
    shards = -(-n // shard)
    ranges = max(1, min(shards, int(spark.conf.get("spark.sql.shuffle.partitions"))))  # of consecutive shards, one range a task
    dealt = placed.mapInArrow(deal, "shard long, n long, block binary").repartitionById(ranges, F.expr(f"cast(shard * {ranges} div {max(shards, 1)} as int)")).sortWithinPartitions("shard")
    index = common.cut(dealt.mapInArrow(write, "shard long, first_slot long, n_sequences long, n_tokens long, crc32 long, path string"))
    layout = {"sequences": n, "tokens": tokens, "window": window, "bytes_per_id": wide, "shard": shard, "key": key, "end": end}
    spark.createDataFrame([(json.dumps(layout),)], "value string").coalesce(1).write.mode("overwrite").text(f"{to}/layout")
    return index


def layout_of(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/layout").first().value)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """What the shards hold: (slot, sequence_id, shard, byte_offset, n_tokens, ids), one row per sequence."""
    layout = layout_of(spark, path)
    window, wide, n, key, shard = (layout[k] for k in ("window", "bytes_per_id", "sequences", "key", "shard"))
    names = ("slot", "sequence_id", "shard", "byte_offset", "n_tokens")
    if not n:
        return spark.createDataFrame([], ", ".join(f"{c} long" for c in names) + ", ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "shard-*.bin").load(path).select(F.regexp_extract("path", r"shard-(\d+)\.bin$", 1).cast("long").alias("shard"), "content")

    def split(frames):
        def rows():
            for frame in frames:
                for number, content in zip(frame.column(0).to_pylist(), frame.column(1)):
                    raw, stride = content.as_buffer(), window * wide
                    slots = number * shard + np.arange(len(raw) // stride)
                    sequences = sequence_at(slots, n, key)
                    for i, (slot, sequence) in enumerate(zip(slots.tolist(), sequences.tolist())):
                        yield slot, sequence, number, i * stride, min(window, layout["tokens"] - sequence * window), raw[i * stride : (i + 1) * stride].to_pybytes()

        yield from common.batches(rows(), pa.schema([*((c, pa.int64()) for c in names), ("ids", pa.binary())]), 5)

    return files.mapInArrow(split, ", ".join(f"{c} long" for c in names) + ", ids binary")


def read_slots(path: str, layout: dict, first: int, count: int) -> np.ndarray:
    """Sequences of the slots from ``first`` on, as a reader in training sees them: plain reads at known places."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(path)
    window, wide, shard = layout["window"], layout["bytes_per_id"], layout["shard"]
    out, last = [], min(first + count, layout["sequences"])
    while first < last:
        number, at = divmod(first, shard)
        take = min(shard - at, last - first)
        with store.open_input_file(f"{root}/shard-{number:08d}.bin") as f:
            out.append(np.frombuffer(f.read_at(take * window * wide, at * window * wide), f"<u{wide}").reshape(take, window))
        first += take
    return np.concatenate(out) if out else np.empty((0, window), f"<u{wide}")
