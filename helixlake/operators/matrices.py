"""Blocked matrices: cells of a matrix gathered into dense blocks, products and norms by shuffles of blocks.

A blocked matrix is a table (i, j, block): block row, block column and ``size`` x ``size`` doubles in row order; blocks that
hold nothing are absent. No row or column of the matrix is ever in one place.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SIZE = 256
SCHEMA = "i long, j long, block binary"
#: Blocks that a task adds up before it hands them over, and the parts into which the sums of one block are first put.
HELD, SALT = 64, 32


def blocked(cells: DataFrame, size: int = SIZE) -> DataFrame:
    """Cells (row, col, value) as a blocked matrix; cells that occur twice are added, null values are 0."""
    at = F.pmod("row", F.lit(size)) * size + F.pmod("col", F.lit(size))
    own = cells.select(F.floor(F.col("row") / size).alias("i"), F.floor(F.col("col") / size).alias("j"), at.cast("int").alias("at"), F.coalesce(F.col("value").cast("double"), F.lit(0.0)).alias("value"))

    def gather(table: pa.Table) -> pa.Table:
        block = np.bincount(table["at"].to_numpy(), table["value"].to_numpy(), size * size)
        return pa.table({"i": table["i"][:1], "j": table["j"][:1], "block": pa.array([block.tobytes()], pa.binary())})

    summed = own.groupBy("i", "j", "at").agg(F.sum("value").alias("value"))  # at most size x size rows a block from here on
    return summed.groupBy("i", "j").applyInArrow(gather, SCHEMA)


def cells(matrix: DataFrame, size: int = SIZE) -> DataFrame:
    """The cells (row, col, value) of a blocked matrix that aren't 0."""

    def spread(frames):
        for frame in frames:
            for i, j, block in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2)):
                x = np.frombuffer(block.as_buffer()).reshape(size, size)
                r, c = np.nonzero(x)
                yield pa.RecordBatch.from_arrays([pa.array(r + i * size), pa.array(c + j * size), pa.array(x[r, c])], names=["row", "col", "value"])

    return matrix.select("i", "j", "block").mapInArrow(spread, "row long, col long, value double")


def transposed(matrix: DataFrame, size: int = SIZE) -> DataFrame:
    def turn(frames):
        for frame in frames:
            blocks = [np.frombuffer(b.as_buffer()).reshape(size, size).T.tobytes() for b in frame.column(2)]
            yield pa.RecordBatch.from_arrays([frame.column(1), frame.column(0), pa.array(blocks, pa.binary())], names=["i", "j", "block"])

    return matrix.select("i", "j", "block").mapInArrow(turn, SCHEMA)


def product(a: DataFrame, b: DataFrame, size: int = SIZE) -> DataFrame:
    """The matrix product: blocks meet by the inner block number, a task adds up what it makes of each block, and the sums are added in two rounds."""
    pairs = a.select("i", F.col("j").alias("k"), F.col("block").alias("x")).join(b.select(F.col("i").alias("k"), "j", F.col("block").alias("y")), "k").select("i", "j", "x", "y")

    def multiply(frames):
        held: dict[tuple[int, int], np.ndarray] = {}
        for frame in frames:
            for i, j, x, y in zip(frame.column(0).to_pylist(), frame.column(1).to_pylist(), frame.column(2), frame.column(3)):
                part = np.frombuffer(x.as_buffer()).reshape(size, size) @ np.frombuffer(y.as_buffer()).reshape(size, size)
                held[i, j] = held[i, j] + part if (i, j) in held else part
                if len(held) == HELD:
                    yield _batch(held)
                    held = {}
        if held:
            yield _batch(held)

    parts = pairs.mapInArrow(multiply, SCHEMA)
    salted = parts.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALT)))
    return _added(_added(salted, ["i", "j", "salt"]), ["i", "j"])


def _batch(held: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([i for i, _ in held], pa.int64()), pa.array([j for _, j in held], pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], names=["i", "j", "block"])


def _added(parts: DataFrame, by: list[str]) -> DataFrame:
    def add(table: pa.Table) -> pa.Table:
        total = None
        for block in table["block"]:
            x = np.frombuffer(block.as_buffer())
            total = x.copy() if total is None else total + x
        return pa.table({"i": table["i"][:1], "j": table["j"][:1], "block": pa.array([total.tobytes()], pa.binary())})

    return parts.groupBy(*by).applyInArrow(add, SCHEMA)


def norm(matrix: DataFrame) -> DataFrame:
    """One row (norm, n): the root of the sum of squares, and how many blocks there are."""

    def squares(frames):
        for frame in frames:
            yield pa.RecordBatch.from_arrays([pa.array([float((np.frombuffer(b.as_buffer()) ** 2).sum()) for b in frame.column(0)], pa.float64())], names=["s"])

    return matrix.select("block").mapInArrow(squares, "s double").agg(F.sqrt(F.coalesce(F.sum("s"), F.lit(0.0))).alias("norm"), F.count("*").alias("n"))
