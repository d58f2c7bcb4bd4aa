"""What the vector operators share: which vectors take part, unit vectors, and blocks of hot groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixlake.llm import common

#: Rows of one block; a group with more is cut into blocks that meet pairwise.
BLOCK = 2048
#: Different lengths of vectors that one table may hold.
LENGTHS = 64


def usable(vector: str) -> Column:
    """Not null, no null or non-finite component, not zero."""
    v = F.col(vector)
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return v.isNotNull() & F.coalesce(F.forall(v, finite) & F.exists(v, lambda x: x != 0), F.lit(False))


def by_length(rows: DataFrame, vector: str) -> list[DataFrame]:
    """The rows with usable vectors, a table for every length that occurs: vectors of different lengths have no product."""
    return tables_by_length(rows.where(usable(vector)), vector)


def tables_by_length(rows: DataFrame, vector: str) -> list[DataFrame]:
    """A table for every length of vectors.

    Lengths are the dimensions of embedding models and so a handful; more than ``LENGTHS`` are an error.
    """
    lengths = [r.n for r in rows.select(F.size(vector).alias("n")).distinct().limit(LENGTHS + 1).collect()]
    if len(lengths) > LENGTHS:
        raise ValueError(f"vectors of more than {LENGTHS} different lengths")
    return [rows.where(F.size(vector) == n) for n in sorted(lengths)]


def class_key(*columns: str) -> list[Column]:
    """Two independent 64-bit hashes, ``h1`` and ``h2``, of the columns that make vectors equal."""
    return [F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit(2), *columns).alias("h2")]


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column as a matrix of doubles, one row per list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; scaled by the largest component first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def in_blocks(rows: DataFrame, group: list[str], spread: Column, size: int = BLOCK) -> DataFrame:
    """``rows`` once for every pair of blocks their own block is in: columns ``own``, ``one`` and ``two`` are added.

    A group of n rows is cut into k = ceil(n / size) blocks by ``spread``; the pairs (one, two), one <= two,
    cover all pairs of rows of the group, and none holds much more than two blocks. Most groups are one block.
    """
    sizes = common.cut(rows.groupBy(*group).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks")))  # so that the join may split a hot group
    both = rows.alias("r").join(sizes.alias("s"), [F.col(f"r.{g}").eqNullSafe(F.col(f"s.{g}")) for g in group]).select("r.*", "s.blocks")
    both = both.withColumn("own", F.pmod(spread, F.col("blocks").cast("long")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other", "blocks")
