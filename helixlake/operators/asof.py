"""Ordered work within keys that doesn't gather a key in one task: running numbers, and the last known values of other events.

Rows are dealt by ranges of (key, order), so a key with many rows lies in several parts one after the other. A
window runs within each part of a key, and what comes before a part is a window over one row a part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.session import cut


def _name(wanted: str, taken: list[str]) -> str:
    while wanted.lower() in {c.lower() for c in taken}:
        wanted = f"_{wanted}"
    return wanted


def dealt(rows: DataFrame, by: list[str], order: list[str], part: str = "part") -> DataFrame:
    """``rows`` in ranges of (by, order), with the number of its range; numbers hold because the rows are written."""
    return cut(rows.repartitionByRange(*by, *order).withColumn(part, F.spark_partition_id()))


def numbered(rows: DataFrame, by: list[str], order: list[str], into: str = "place") -> DataFrame:
    """``into``: the number of each row within its key from 1, by ``order``; rows that are equal in it come in any order."""
    one = _name("one", [*rows.columns, into])
    out = summed(rows.withColumn(one, F.lit(1)), by, order, one, into).drop(one)
    return out.withColumn(into, F.col(into) + 1)


def summed(rows: DataFrame, by: list[str], order: list[str], amount: str, into: str) -> DataFrame:
    """``into``: the sum of ``amount`` over the rows of the key that come before by ``order``."""
    part = _name("part", [*rows.columns, into])
    before, local = _name("before", [*rows.columns, part, into]), _name("local", [*rows.columns, part, into])
    own = dealt(rows, by, order, part)
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = own.groupBy(*by, part).agg(F.sum(amount).alias(local)).select(*by, part, F.coalesce(F.sum(local).over(earlier), F.lit(0)).alias(before))
    run = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumn(local, F.coalesce(F.sum(amount).over(run), F.lit(0)))
    return _with(own, cut(starts), [*by, part]).select(*rows.columns, (F.col(local) + F.col(before)).alias(into))


def carried(rows: DataFrame, by: list[str], order: list[str], values: list[str]) -> DataFrame:
    """Each of ``values`` becomes the row's own, or else its key's last known one before it by ``order``; null where none came before."""
    part = _name("part", rows.columns)
    known = {}
    for c in values:
        known[c] = _name(f"known_{c}", [*rows.columns, part, *known.values()])
    own = dealt(rows, by, order, part)
    last = own.groupBy(*by, part).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order))).alias(n) for c, n in known.items()])
    earlier = Window.partitionBy(*by).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    before = last.select(*by, part, *[F.last(n, ignorenulls=True).over(earlier).alias(n) for n in known.values()])
    run = Window.partitionBy(*by, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = own.withColumns({c: F.last(c, ignorenulls=True).over(run) for c in values})
    return _with(own, cut(before), [*by, part]).select(*[F.coalesce(c, known[c]).alias(c) if c in known else F.col(c) for c in rows.columns])


def _with(rows: DataFrame, few: DataFrame, on: list[str]) -> DataFrame:
    """``rows`` with the one row of ``few`` that has the same key, null keys too."""
    r, s = rows.alias("r"), few.alias("s")
    same = F.lit(True)
    for c in on:
        same = same & F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}"))
    return r.join(s, same).select("r.*", *[f"s.{c}" for c in few.columns if c not in on])


def as_of(sources: dict[str, DataFrame], by: list[str], at: str, tie: str) -> DataFrame:
    """All events of all sources in one table: (by, at, source, tie, a column of each source), each column the last known value of its source.

    A source is (by, at, tie, a column called like it). Sources come in the order given where times are equal, so a later
    source's event knows those of earlier sources at its own time; within a source ``tie`` decides.
    """
    parts = []
    for rank, (name, events) in enumerate(sources.items()):
        own = [F.col(n) if n == name else F.lit(None).cast(t.schema[n].dataType).alias(n) for n, t in sources.items()]
        parts.append(events.select(*by, at, F.lit(rank).alias("rank"), F.lit(name).alias("source"), tie, *own))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return carried(both, by, [at, "rank", tie], list(sources)).drop("rank")
