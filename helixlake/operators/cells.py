"""Operators on small groups that are sequential by nature: communities, hulls, codons, bootstrap intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

#: The most frequent codon of each residue in yeast, and its frequency.
CODONS = {
    "A": ("GCT", 0.38), "C": ("TGT", 0.63), "D": ("GAT", 0.65), "E": ("GAA", 0.70), "F": ("TTT", 0.59), "G": ("GGT", 0.47), "H": ("CAT", 0.64), "I": ("ATT", 0.46),
    "K": ("AAA", 0.58), "L": ("TTG", 0.29), "M": ("ATG", 1.00), "N": ("AAT", 0.59), "P": ("CCA", 0.42), "Q": ("CAA", 0.69), "R": ("AGA", 0.48), "S": ("TCT", 0.26),
    "T": ("ACT", 0.35), "V": ("GTT", 0.39), "W": ("TGG", 1.00), "Y": ("TAT", 0.56),
}


def communities(edges: DataFrame, by: str = "dataset", rounds: int = 10) -> DataFrame:
    """(dataset, node, community): nodes move, in order, to the neighbouring community with the largest modularity gain, up to ``rounds`` passes.

    A grouped function per dataset, as each move depends on those before it; communities are numbered by first appearance.
    """
    import pandas as pd

    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict = {}
        for i, j in pdf[["i", "j"]].itertuples(index=False):
            near.setdefault(i, set()).add(j)
            near.setdefault(j, set()).add(i)
        nodes = sorted(near)
        of, degree = {i: i for i in nodes}, {i: len(near[i]) for i in nodes}
        total = dict(degree)
        twice = sum(degree.values()) or 1
        for _ in range(rounds):
            moved = False
            for i in nodes:
                gains: dict = {}
                for j in sorted(near[i]):
                    if of[j] != of[i]:
                        gains[of[j]] = gains.get(of[j], 0.0) + 1 - degree[i] * total[of[j]] / twice
                best = max(gains, key=lambda c: (gains[c], -c), default=None)
                if best is not None and gains[best] > 0:
                    total[of[i]] -= degree[i]
                    total[best] += degree[i]
                    of[i], moved = best, True
            if not moved:
                break
        number = {c: n for n, c in enumerate(dict.fromkeys(of[i] for i in nodes))}
        return pd.DataFrame({by: pdf[by].iloc[0], "node": nodes, "community": [number[of[i]] for i in nodes]})

    kinds = {f.name: f.dataType.simpleString() for f in edges.schema}
    return edges.select(by, "i", "j").groupBy(by).applyInPandas(move, f"{by} {kinds[by]}, node {kinds['i']}, community long")


def hulls(points: DataFrame, by: str) -> DataFrame:
    """(group, place, x, y): corners of the convex hull of each group, counter-clockwise from the leftmost.

    Partitions first reduce their points to local hulls, so that a group's corners and not its points are shuffled.
    """
    import pandas as pd

    def hull(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
        def half(points):
            out: list[tuple[float, float]] = []
            for p in points:
                while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                    out.pop()
                out.append(p)
            return out[:-1]

        own = sorted(set(xy))
        return own if len(own) < 3 else half(own) + half(own[::-1])

    def corners(pdf: pd.DataFrame) -> list[tuple[float, float]]:
        return hull(list(pdf[["x", "y"]].itertuples(index=False, name=None)))

    def local(frames):
        for frame in frames:
            yield pd.DataFrame([(k, *p) for k, g in frame.groupby(by) for p in corners(g)], columns=[by, "x", "y"])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame([(pdf[by].iloc[0], n, *p) for n, p in enumerate(corners(pdf))], columns=[by, "place", "x", "y"])

    kind = points.schema[by].dataType.simpleString()
    return points.where("x IS NOT NULL AND y IS NOT NULL").select(by, "x", "y").mapInPandas(local, f"{by} {kind}, x double, y double").groupBy(by).applyInPandas(final, f"{by} {kind}, place long, x double, y double")


def codon_optimised(proteins: DataFrame) -> DataFrame:
    """(id, dna, cai, gc): the best codon of each residue, NNN for others; adaptation is the geometric mean of frequencies."""
    import numpy as np
    import pyarrow as pa

    codons, logs, known = np.full((256, 3), ord("N"), np.uint8), np.zeros(256), np.zeros(256, bool)
    for a, (codon, weight) in CODONS.items():
        codons[ord(a)], logs[ord(a)], known[ord(a)] = list(codon.encode()), np.log(weight), True

    def translate(batches):
        for b in (b.slice(i, 1024) for b in batches for i in range(0, b.num_rows, 1024)):
            text = b["seq"].cast(pa.large_string())
            ends = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + b.num_rows + 1]
            letters = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
            ends = ends - ends[0]
            there = np.flatnonzero(np.diff(ends))  # no sums over empty ranges
            sums = np.zeros((2, b.num_rows))
            if len(there):
                sums[:, there] = [np.add.reduceat(x[letters].astype(float), ends[there]) for x in (known, logs)]
            dna = pa.LargeStringArray.from_buffers(b.num_rows, pa.py_buffer((ends * 3).tobytes()), pa.py_buffer(codons[letters].tobytes()))
            yield pa.RecordBatch.from_arrays([b["id"], dna.cast(pa.string()), *map(pa.array, sums)], ["id", "dna", "known", "logs"])

    kind = proteins.schema["id"].dataType.simpleString()
    one = F.coalesce(F.regexp_replace("seq", f"[^{''.join(CODONS)}]", "-"), F.lit("")).alias("seq")  # a byte a letter
    t = proteins.select("id", one).mapInArrow(translate, f"id {kind}, dna string, known double, logs double")
    cai = F.when(F.col("known") > 0, F.exp(F.col("logs") / F.col("known"))).otherwise(0.0)
    gc = m.ratio((F.length("dna") - F.length(F.translate("dna", "GC", ""))) * 100.0, F.length("dna"))
    return t.select("id", "dna", m.js_round(cai, 3).alias("cai"), m.js_round(gc, 3).alias("gc"))


def block_pairs(rows: DataFrame, by: str, key: str, size: int = 2048) -> DataFrame:
    """``rows`` once for every pair of blocks that their own block is in, as ``own``, ``one`` and ``two``; a group has one block per ``size`` rows."""
    sizes = rows.groupBy(by).agg(F.ceil(F.count("*") / size).cast("int").alias("blocks"))
    both = rows.join(sizes, by).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks").cast("long")).cast("int"))
    both = both.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return both.withColumn("one", F.least("own", "other")).withColumn("two", F.greatest("own", "other")).drop("other", "blocks")


def mean_pair_distance(points: DataFrame, by: str, key: str, dims: list[str]) -> DataFrame:
    """(group, n_pairs, distance): mean Euclidean distance over all pairs of a group, 0 for a single point.

    Every pair counts, so the work grows with the square of a group; blocks keep tasks bounded, and only their sums leave them.
    """
    import numpy as np
    import pyarrow as pa

    def add(table: pa.Table) -> pa.Table:
        own, one, two = table["own"].to_numpy(), table["one"][0].as_py(), table["two"][0].as_py()
        x = np.stack([table[d].to_numpy() for d in dims], axis=1)
        a, b = x[own == one], x[own == two]
        total = sum(float(np.sqrt(((a[i : i + 256, None] - b[None]) ** 2).sum(2)).sum()) for i in range(0, len(a), 256)) + 0.0
        pairs = len(a) * (len(a) - 1) / 2 if one == two else len(a) * len(b)
        return pa.table({by: table[by].slice(0, 1), "pairs": [float(pairs)], "total": [total / 2 if one == two else total]})

    kind = points.schema[by].dataType.simpleString()
    cut = block_pairs(points.select(by, key, *dims), by, key)
    sums = cut.groupBy(by, "one", "two").applyInArrow(add, f"{by} {kind}, pairs double, total double").groupBy(by).agg(F.sum("pairs").alias("n"), F.sum("total").alias("total"))
    return sums.select(by, F.col("n").cast("long").alias("n_pairs"), F.coalesce(F.try_divide("total", "n"), F.lit(0.0)).alias("distance"))
