"""Hashes and generators that ids and seeded draws are made of, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def code_points(x: Column) -> Column:
    return F.transform(F.filter(F.split(x, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))


def fnv1a(x: Column) -> Column:
    """32-bit FNV-1a over code points below 2**32, as a long."""
    return F.aggregate(code_points(x), F.lit(2166136261).cast("long"), lambda h, c: (h.bitwiseXOR(c) * 16777619) % 4294967296)


def times31(x: Column) -> Column:
    """The string hash h * 31 + c as a signed 32-bit number."""
    h = F.aggregate(code_points(x), F.lit(0).cast("long"), lambda h, c: (h * 31 + c) % 4294967296)
    return F.when(h >= 2147483648, h - 4294967296).otherwise(h)


def lcg(seed: Column, n: Column) -> Column:
    """The first ``n`` draws in 0..1 of the 32-bit generator 1664525 h + 1013904223."""
    start = F.struct((seed % 4294967296).alias("h"), F.array().cast("array<double>").alias("out"))

    def step(acc, _):
        h = (acc["h"] * 1664525 + 1013904223) % 4294967296
        return F.struct(h.alias("h"), F.concat(acc["out"], F.array(h / 4294967296.0)).alias("out"))

    return F.aggregate(F.sequence(F.lit(1), n), start, step, lambda acc: acc["out"])


def entry_id(*parts: Column) -> Column:
    """A provenance id: the FNV-1a of the parts joined by bars, in base 36."""
    return F.concat(F.lit("prov_"), F.lower(F.conv(fnv1a(F.concat_ws("|", *parts)).cast("string"), 10, 36)))
