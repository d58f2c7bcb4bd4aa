"""Embedding near-duplicates with a forest of random-projection trees.

Trees are fitted on a bounded sample: each level projects on a random direction and each node splits
at its sample's median; a vector within a margin of the split goes down both sides. Equal labels are
compared within leaves only. A leaf yields a star per cluster it sees and not its pairs; clusters that
share a vector in any tree are united, and within a united group every pair is compared exactly to
count its links.
"""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common, vectors

SIMILAR = 0.93
TREES = 4
#: Vectors of a label that a leaf should hold.
LEAF = 96
#: Half the width of the zone that goes to both sides, in units of 1 / sqrt(dimensions).
MARGIN = 0.25
#: Vectors the trees are fitted on at most, and the fewest a node needs to split them further.
FIT_ROWS, FIT_NODE = 16_384, 32


class Forest(NamedTuple):
    """``directions``: trees x levels x dimensions. ``splits[t][l]``: thresholds of level l by node of level min(l, fitted)."""

    directions: np.ndarray
    splits: list[list[np.ndarray]]
    fitted: int
    margin: float

    def leaves(self, x: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, tree, path) of every leaf that the unit rows of ``x`` reach, each at its own depth."""
        out = []
        for t, levels in enumerate(self.splits):
            at, path = np.arange(len(x)), np.zeros(len(x), np.int64)
            for level in range(len(levels) + 1):
                done = depth[at] <= level
                if done.any():
                    out.append((at[done], np.full(done.sum(), t), path[done]))
                    at, path = at[~done], path[~done]
                if not len(at):
                    break
                node = path >> max(0, level - self.fitted)
                above = (x @ self.directions[t, level])[at] - levels[level][node]
                left, right = above <= self.margin, above > -self.margin
                at, path = np.concatenate([at[left], at[right]]), np.concatenate([path[left] * 2, path[right] * 2 + 1])
        return tuple(np.concatenate(c) for c in zip(*out)) if out else (np.empty(0, int),) * 3


def grow(sample: np.ndarray, depth: int, trees: int = TREES, margin: float = MARGIN, seed: int = 7) -> Forest:
    """Fit the splits on unit vectors; below the level whose nodes are down to ``FIT_NODE`` a node keeps that level's sample."""
    rng = np.random.default_rng(seed)
    n, d = sample.shape
    directions = rng.normal(size=(trees, max(depth, 1), d))
    directions /= np.linalg.norm(directions, axis=2, keepdims=True)
    fitted = max(0, min(depth, int(math.log2(max(1, n / FIT_NODE)))))
    splits = []
    for t in range(trees):
        node, levels = np.zeros(n, np.int64), []
        for level in range(depth):
            p = sample @ directions[t, level]
            nodes = 1 << min(level, fitted)
            cut = np.zeros(nodes)
            order = np.argsort(node, kind="stable")
            bounds = np.searchsorted(node[order], np.arange(nodes + 1))
            for k in range(nodes):
                own = p[order[bounds[k] : bounds[k + 1]]]
                cut[k] = np.median(own) if len(own) else 0.0
            levels.append(cut)
            if level < fitted:
                node = node * 2 + (p > cut[node])
        splits.append(levels)
    return Forest(directions, splits, fitted, margin / math.sqrt(d))


def local_roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest index of each one's cluster under the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _halves(table: pa.Table) -> tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]:
    """Unit vectors of a block pair, and the index of either block in them."""
    own = table["own"].to_numpy()
    one, two = table["one"][0].as_py(), table["two"][0].as_py()
    return table, vectors.unit(vectors.matrix(table["v"])), np.flatnonzero(own == one), np.flatnonzero(own == two)


def _links(x: np.ndarray, a: np.ndarray, b: np.ndarray, similar: float, step: int = 1024):
    """Linked index pairs between the two blocks (each pair once if they are the same block)."""
    same = len(a) == len(b) and (a == b).all()
    for at in range(0, len(a), step):
        rows = a[at : at + step]
        i, j = np.nonzero(x[rows] @ x[b].T >= similar)
        i, j = rows[i], b[j]
        keep = i < j if same else i != j
        yield i[keep], j[keep]


def link_vectors(rows: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", similar: float = SIMILAR, trees: int = TREES, leaf: int = LEAF, margin: float = MARGIN) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Rows link when their labels are equal and not null and their cosine in double precision is at least
    ``similar``. Vectors of different lengths never link. Vectors that are null, zero or that hold null or
    non-finite components link with nothing: no links, their own component, kept. Equal vectors of a label
    are one class until the end, so copies cost nothing. Repeated ids are rows like others; null ids are never named as a component
    unless no member has an id, and a row without an id is never ``kept``. An empty table gives an empty one.
    """
    base = rows.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("v"))
    able = base.where("label IS NOT NULL")
    found = able.sparkSession.createDataFrame([], "h1 long, h2 long, component_id long, n_links long").withColumn("component_id", F.col("component_id").cast(base.schema["vec_id"].dataType))
    for good in vectors.by_length(able, "v"):
        classes = good.groupBy("label", *vectors.class_key("label", "v")).agg(F.first("v").alias("v"), F.min("vec_id").alias("first_id"), F.count("*").alias("n"))
        classes = common.cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # ids hold once they are written
        counts = common.cut(classes.groupBy("label").count())
        linked = _components(classes, counts, counts.agg(F.max("count")).first()[0], similar, trees, leaf, margin)
        found = found.union(classes.select("h1", "h2", "cid").join(linked, "cid").select("h1", "h2", "component_id", "n_links"))
    takes_part = vectors.usable("v") & F.col("label").isNotNull()
    keyed = base.select("vec_id", *(F.when(takes_part, h).alias(f"h{i}") for i, h in enumerate(vectors.class_key("label", "v"), 1)))
    out = keyed.join(found.withColumnRenamed("component_id", "c"), ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("c"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _components(classes: DataFrame, counts: DataFrame, most: int, similar: float, trees: int, leaf: int, margin: float) -> DataFrame:
    spark, total = classes.sparkSession, classes.count()
    share = min(1.0, FIT_ROWS / total)
    sample = classes.where(F.pmod(F.xxhash64("cid", F.lit("fit")), F.lit(1 << 30)) < int(share * (1 << 30))).select("v")
    sample = vectors.unit(vectors.matrix(sample.toArrow()["v"])) if total else np.zeros((0, 1))  # about FIT_ROWS vectors at most
    if not len(sample):
        sample = vectors.unit(vectors.matrix(classes.select("v").limit(FIT_NODE).toArrow()["v"]))
    depth = max(0, math.ceil(math.log2(most / leaf)))
    forest = spark.sparkContext.broadcast(grow(sample, depth, trees, margin))  # trees * (levels * dimensions + FIT_ROWS) doubles

    deep = F.greatest(F.lit(0), F.ceil(F.log2(F.col("count") / leaf))).cast("int")
    ready = classes.join(counts, "label").select("label", "cid", deep.alias("depth"), "v")

    def descend(frames):
        for frame in frames:
            x = vectors.unit(vectors.matrix(frame.column(3)))
            row, tree, path = forest.value.leaves(x, frame.column(2).to_numpy())
            for at in range(0, len(row), 8192):
                take = pa.array(row[at : at + 8192])
                yield pa.RecordBatch.from_arrays([frame.column(0).take(take), frame.column(1).take(take), pa.array(path[at : at + 8192] * trees + tree[at : at + 8192]), frame.column(3).take(take)], names=["label", "cid", "cell", "v"])

    ids = [classes.schema["label"], classes.schema["cid"]]
    cells = ready.mapInArrow(descend, T.StructType([*ids, T.StructField("cell", T.LongType()), classes.schema["v"]]))

    def stars(table: pa.Table) -> pa.Table:
        table, x, a, b = _halves(table)
        found = list(_links(x, a, b, similar))
        root = local_roots(len(x), np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])) if found else np.arange(len(x))
        cid, member = table["cid"].to_numpy(), np.flatnonzero(root != np.arange(len(x)))
        return pa.table({"a": cid[member], "b": cid[root[member]]})

    edges = vectors.in_blocks(cells, ["label", "cell"], F.xxhash64("cid", F.lit("leaf"))).groupBy("label", "cell", "one", "two").applyInArrow(stars, "a long, b long")
    groups = common.components(edges)

    def count(table: pa.Table) -> pa.Table:
        table, x, a, b = _halves(table)
        weight, links = table["n"].to_numpy().astype(float), np.zeros(len(x))
        for i, j in _links(x, a, b, similar):
            np.add.at(links, i, weight[j])
            np.add.at(links, j, weight[i])
        return pa.table({"cid": table["cid"], "links": links.astype(np.int64)})

    members = common.cut(classes.join(groups.withColumnRenamed("node", "cid"), "cid").select("component", "cid", "first_id", "n", "v"))
    links = vectors.in_blocks(members.select("component", "cid", "n", "v"), ["component"], F.xxhash64("cid", F.lit("pair"))).groupBy("component", "one", "two").applyInArrow(count, "cid long, links long").groupBy("cid").agg(F.sum("links").alias("links"))
    named = members.groupBy("component").agg(F.min("first_id").alias("component_id"))
    of = members.select("component", "cid").join(named, "component").join(links, "cid").select("cid", "component_id", "links")
    out = classes.join(of, "cid", "left").select("cid", F.coalesce("component_id", "first_id").alias("component_id"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"))
    return common.cut(out)
