"""Helpers that several training-data operators share."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.session import cut, shared_dir  # noqa: F401

#: Bytes of payload after which a Python worker hands a record batch back to the JVM.
OUT_BYTES = 8 << 20


def partition_id() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def batches(rows: Iterator[tuple], schema: pa.Schema, weigh: int | None = None) -> Iterator[pa.RecordBatch]:
    """Record batches of bounded size out of row tuples; ``weigh`` is the column whose length counts."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + (len(row[weigh]) if weigh is not None and row[weigh] is not None else 0)
        if size >= OUT_BYTES:
            yield to_batch(held, schema)
            held, size = [], 0
    if held:
        yield to_batch(held, schema)


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """Arrow type of one column, for operators that carry an id of any type through Python."""
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


@functools.cache
def byte_level_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and their merge ranks out of a byte-level BPE ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        vocab = json.load(f)["model"]["vocab"]
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
    return {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if all(c in byte_of for c in token)}


@functools.cache
def fast_encoding(path: str, pattern: str):
    """The vocabulary of a ``tokenizer.json`` in tiktoken's encoder: the ids of the tokenizers library, three times as fast."""
    import tiktoken

    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_level_ranks(path), special_tokens={})


def quoted(names: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever signs they hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in names]


def plain_names(df: DataFrame) -> DataFrame:
    """The columns called c0, c1, ...: functions over Arrow batches can't be given all names."""
    return df.select([c.alias(f"c{i}") for i, c in enumerate(quoted(df.columns))])


def row_key(*columns: str) -> Column:
    """A 128-bit digest of the named columns of a row, nulls told from other values; it stands for the row in joins."""
    parts = [part for c in quoted(columns) for part in (c.isNull().cast("string"), F.coalesce(c.cast("string"), F.lit("")))]
    return F.unhex(F.md5(F.concat_ws("\0", *parts).cast("binary")))


def free_name(wanted: str, taken: list[str]) -> str:
    """``wanted``, with underscores before it until no column has the name, in whatever case."""
    lower = {c.lower() for c in taken}
    while wanted.lower() in lower:
        wanted = f"_{wanted}"
    return wanted


def settled(df: DataFrame, rows: int = 200_000) -> DataFrame:
    """Cut, and put into partitions of about ``rows`` rows: small tables then need few tasks, and none to be dealt out."""
    out = cut(df)
    return out.coalesce(max(1, -(-out.count() // rows)))


def components(edges: DataFrame, a: str = "a", b: str = "b", most: int = 60, rows: int = 200_000) -> DataFrame:
    """Connected components of an edge list: (node, component), the component being its smallest node.

    Alternating large-star and small-star rounds; every round is cut to the shared folder and put into
    partitions of about ``rows`` edges, and the driver only sees one count and one checksum per round.
    Nodes without an edge aren't in the result.
    """
    e = settled(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), rows)
    seen = None
    for _ in range(most):
        n = e.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("s")).select("s.x", "s.y")
        m = settled(n.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m")), rows)  # a table, so that the join may split a hub
        large = n.join(m, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        both = F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u").alias("u"), F.col("m").alias("v")))
        e = cut(large.join(low, "u").select(F.explode(both).alias("s")).select("s.u", "s.v").where("u <> v").distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        e = e.coalesce(max(1, -(-now[0] // rows)))
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {most} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(e.select(F.col("v"), F.col("v")).distinct())


# Word hashing over whole byte buffers: a polynomial prefix hash modulo 2**64 gives every
# word's hash from two prefix sums, so no Python object is made per word.
_P = np.uint64(0x9E3779B97F4A7C15)
_P_INV = np.uint64(pow(int(_P), -1, 1 << 64))


@functools.lru_cache(maxsize=4)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_P, _P_INV):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser of 64-bit hashes."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    return h ^ (h >> np.uint64(29))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every data[start:end]; ``data`` uint8."""
    if not len(starts):
        return np.empty(0, np.uint64)
    n = len(data)
    size = 1 << max(12, (n - 1).bit_length())
    power, inverse = _powers(size)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD1B54A32D192ED03))
