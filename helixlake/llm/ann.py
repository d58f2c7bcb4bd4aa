"""Approximate nearest neighbours with a hierarchical k-means tree.

The tree is fitted on a bounded sample, every vector goes to a leaf. A query walks the tree best bin
first: a priority queue holds the open nodes by the inner product with their centroids, and leaves are
visited until the number that calibration asks for. Calibration compares some queries with everything,
and widens the visits until the wanted recall is reached on them.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from helixlake.llm import common, vectors

#: Sample the tree is fitted on; children of a node; sample vectors below which a node is a leaf.
FIT_ROWS, BRANCH, LEAF_POINTS = 16_384, 8, 48
#: Queries compared with everything, and the mean share of their true neighbours that must lie in visited leaves.
CALIBRATION, RECALL = 256, 0.95
#: Most vectors, and most queries, that meet in one task's block; leaves that share a bin.
BLOCK, BIN = 4096, 16


class Tree(NamedTuple):
    """``centroids[n]`` of node n; ``children[n]`` are nodes, none for leaves, which ``leaf[n]`` numbers from 0."""

    centroids: np.ndarray
    children: list[np.ndarray]
    leaf: np.ndarray

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of every row: down to the nearest centroid."""
        out, todo = np.empty(len(x), np.int64), [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            below = self.children[node]
            if not len(below):
                out[rows] = self.leaf[node]
                continue
            near = nearest(x[rows], self.centroids[below])
            todo += [(child, rows[near == k]) for k, child in enumerate(below) if (near == k).any()]
        return out

    def best_first(self, query: np.ndarray, leaves: int) -> list[int]:
        """The first ``leaves`` leaves of a best-bin-first walk."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < leaves:
            _, node = heapq.heappop(queue)
            below = self.children[node]
            if not len(below):
                out.append(int(self.leaf[node]))
                continue
            for score, child in zip((self.centroids[below] @ query).tolist(), below.tolist()):
                heapq.heappush(queue, (-score, child))
        return out


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.argmin((centroids * centroids).sum(1) - 2 * (x @ centroids.T), axis=1)


def fit(sample: np.ndarray, branch: int = BRANCH, leaf_points: int = LEAF_POINTS, rounds: int = 10, seed: int = 11) -> Tree:
    """Split by k-means until nodes are small or hold equal points only."""
    rng = np.random.default_rng(seed)
    centroids, children, leaf, leaves = [sample.mean(0) if len(sample) else np.zeros(sample.shape[1])], [np.empty(0, int)], [-1], 0
    todo = [(0, np.arange(len(sample)))]
    while todo:
        node, rows = todo.pop()
        points = np.unique(sample[rows], axis=0) if len(rows) > leaf_points else sample[:0]
        if len(points) <= max(1, leaf_points // 4):
            leaf[node], leaves = leaves, leaves + 1
            continue
        k = min(branch, len(points))
        centre = points[rng.choice(len(points), k, replace=False)]
        for _ in range(rounds):
            near = nearest(points, centre)
            centre = np.stack([points[near == i].mean(0) if (near == i).any() else centre[i] for i in range(k)])
        near = nearest(sample[rows], centre)
        parts = [(centre[i], rows[near == i]) for i in range(k) if (near == i).any()]
        if len(parts) < 2:
            leaf[node], leaves = leaves, leaves + 1
            continue
        children[node] = np.arange(len(centroids), len(centroids) + len(parts))
        for c, own in parts:
            todo.append((len(centroids), own))
            centroids.append(c)
            children.append(np.empty(0, int))
            leaf.append(-1)
    return Tree(np.stack(centroids), children, np.array(leaf))


def _share(key: str, wanted: int, total: int, salt: str):
    """Keeps about ``wanted`` of ``total`` rows, chosen by a hash of ``key``."""
    return F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(1 << 30)) < int(min(1.0, wanted / max(total, 1)) * (1 << 30))


def _best(rows: DataFrame, by: str, k: int) -> DataFrame:
    order = Window.partitionBy(by).orderBy(F.desc("score"), F.asc("first_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _top(score: np.ndarray, first_id: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best by falling score, then rising id."""
    if len(score) > k:
        edge = np.partition(score, len(score) - k)[len(score) - k]
        rows = np.flatnonzero(score >= edge)
    else:
        rows = np.arange(len(score))
    return rows[np.lexsort((first_id[rows], -score[rows]))][:k]


def search(rows: DataFrame, queries, *, k: int = 20, vec_id: str = "vec_id", vector: str = "embedding", recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of every row for which ``queries`` (a condition on vec_id) holds.

    Nearness is the largest inner product, in doubles, ties go to the smaller id; a row whose id is the
    query's takes no part in its list, nor does a vector of another length. Vectors that are null, zero or
    with null or non-finite components, and rows with a null id, are neither queries nor candidates. Repeated
    rows (same id and vector) count once; an id with vectors of several lengths has a list for each. Equal vectors are one class in the index, of which the ids that
    can reach a list, the smallest k and one more, are kept: the others can't be in any. A query visits as many
    leaves as calibration says, and more where these hold too few for a list. An empty table gives an empty one.
    """
    base = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).alias("v")).where("vec_id IS NOT NULL")
    out = base.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for good in vectors.by_length(base, "v"):
        out = out.union(_search(good, queries, k, recall, block))
    return out


def _search(good: DataFrame, queries, k: int, recall: float, block: int) -> DataFrame:
    """:func:`search` among usable vectors of one length."""
    wanted = queries(F.col("vec_id"))
    # rows of one id with several vectors are all left out of that id's lists, so look further by as many
    hashed = good.select("vec_id", *vectors.class_key("v"), "v")
    again = hashed.where(wanted).groupBy("vec_id").agg(F.count_distinct("h1", "h2").alias("n")).agg(F.max("n")).first()[0] or 1
    deep = k + again
    single = hashed.groupBy("h1", "h2", "vec_id").agg(F.first("v").alias("v"))
    ranked = single.withColumn("place", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("vec_id"))).where(F.col("place") <= deep)
    classes = ranked.groupBy("h1", "h2").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min("vec_id").alias("first_id"))
    classes = common.cut(classes.withColumn("cid", F.monotonically_increasing_id()))  # ids hold once they are written
    asked = common.cut(hashed.where(wanted).select("vec_id", "h1", "h2").distinct().join(classes.select("h1", "h2", "cid"), ["h1", "h2"]).select("vec_id", "cid"))
    probes = common.cut(classes.join(asked.select("cid").distinct(), "cid", "left_semi").select("cid", "v"))

    total, questions = classes.count(), probes.count()
    sample = classes.where(_share("cid", FIT_ROWS, total, "fit")).select("v").toArrow()["v"]  # about FIT_ROWS vectors
    if not len(sample):
        sample = classes.select("v").limit(LEAF_POINTS).toArrow()["v"]
    tree = fit(vectors.matrix(sample) if len(sample) else np.zeros((0, 1)))
    sent = classes.sparkSession.sparkContext.broadcast(tree)  # at most 2 * FIT_ROWS centroids

    def place(frames):
        for frame in frames:
            yield pa.RecordBatch.from_arrays([*frame.columns, pa.array(sent.value.assign(vectors.matrix(frame.column(1))))], names=["cid", "v", "ids", "first_id", "leaf"])

    index = common.cut(classes.select("cid", "v", "ids", "first_id").mapInArrow(place, T.StructType([*(classes.schema[c] for c in ("cid", "v", "ids", "first_id")), T.StructField("leaf", T.LongType())])))
    leaves = _calibrate(index, probes.where(_share("cid", CALIBRATION, questions, "calibrate")), tree, k, recall)
    every = int((tree.leaf >= 0).sum())
    held = np.zeros(every, np.int64)
    for r in index.groupBy("leaf").agg(F.sum(F.size("ids")).alias("n")).toLocalIterator():  # a row for each leaf of the tree
        held[r.leaf] = r.n
    sizes = classes.sparkSession.sparkContext.broadcast(held)

    def reached(q: np.ndarray) -> np.ndarray:
        """The leaves that a query visits: as many as calibration says, and on until they hold what a list needs."""
        found = np.asarray(sent.value.best_first(q, leaves))
        if sizes.value[found].sum() < deep:
            found = np.asarray(sent.value.best_first(q, every))
            found = found[: int(np.searchsorted(np.cumsum(sizes.value[found]), deep)) + 1]
        return found

    def visit(frames):
        for frame in frames:
            for at in range(0, frame.num_rows, 256):
                part = frame.slice(at, 256)
                found = [np.sort(reached(q)) for q in vectors.matrix(part.column(1))]
                bins = [np.unique(f // BIN, return_index=True) for f in found]
                take = pa.array(np.repeat(np.arange(len(found)), [len(b) for b, _ in bins]))
                lists = [x for f, (_, first) in zip(found, bins) for x in np.split(f, first[1:])]
                yield pa.RecordBatch.from_arrays([part.column(0).take(take), part.column(1).take(take), pa.array(np.concatenate([b for b, _ in bins])), pa.array(lists, pa.list_(pa.int64()))], names=["cid", "v", "bin", "leaves"])

    visits = probes.mapInArrow(visit, T.StructType([probes.schema["cid"], probes.schema["v"], T.StructField("bin", T.LongType()), T.StructField("leaves", T.ArrayType(T.LongType()))]))
    near = _best(_meet(index, visits, deep, block), "qid", deep)
    ids = near.select("qid", "score", F.explode("ids").alias("id"))
    lists = common.cut(ids.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id")))).where(F.col("place") <= deep).select("qid", "score", "id"))
    own = asked.withColumnRenamed("vec_id", "query_id").join(lists, asked.cid == lists.qid).where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("id"))
    return own.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")


def _calibrate(index: DataFrame, probes: DataFrame, tree: Tree, k: int, recall: float) -> int:
    """Leaves to visit so that the calibration queries find ``recall`` of what a comparison with everything finds."""
    sample = probes.toArrow()  # about CALIBRATION vectors
    every = int((tree.leaf >= 0).sum())
    if not sample.num_rows:
        return every
    q, qid = vectors.matrix(sample["v"]), sample["cid"].to_numpy()

    def compare(frames):
        for frame in frames:
            score, first, leaf, cid = q @ vectors.matrix(frame.column(1)).T, frame.column(3).to_numpy(), frame.column(4).to_numpy(), frame.column(0).to_numpy()
            for i in range(len(q)):
                own = np.flatnonzero(cid != qid[i])
                top = own[_top(score[i][own], first[own], k)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(top), i)), pa.array(score[i][top]), pa.array(first[top]), pa.array(leaf[top])], names=["i", "score", "first_id", "leaf"])

    truth = _best(index.mapInArrow(compare, "i long, score double, first_id long, leaf long"), "i", k).select("i", "leaf").toArrow()  # k rows per calibration query
    place = [{x: n for n, x in enumerate(tree.best_first(v, every))} for v in q]
    needed = np.sort([place[i][x] + 1 for i, x in zip(truth["i"].to_pylist(), truth["leaf"].to_pylist())])
    return int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if len(needed) else every


def _meet(index: DataFrame, visits: DataFrame, k: int, block: int) -> DataFrame:
    """(qid, score, first_id, ids) of the k best classes of every visited block; no block is larger than ``block``.

    Leaves that are near in the tree share a bin, and a query goes to a bin once, with the leaves it visits there.
    """
    index = index.withColumn("bin", F.expr(f"leaf div {BIN}"))
    held = index.groupBy("bin").agg(F.ceil(F.count("*") / block).cast("int").alias("nv"))
    asked = visits.groupBy("bin").agg(F.ceil(F.count("*") / block).cast("int").alias("nq"))
    cuts = common.cut(held.join(asked, "bin"))
    spread = lambda n: F.pmod(F.xxhash64("cid", F.lit("block")), F.col(n).cast("long")).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = index.join(cuts, "bin").withColumn("bv", spread("nv")).withColumn("bq", each("nq")).select("bin", "bv", "bq", "leaf", "v", "ids", "first_id")
    right = visits.join(cuts, "bin").withColumn("bq", spread("nq")).withColumn("bv", each("nv")).select("bin", "bv", "bq", "cid", "v", "leaves")

    def compare(held: pa.Table, asked: pa.Table) -> pa.Table:
        empty = pa.table({"qid": pa.array([], pa.int64()), "score": pa.array([], pa.float64()), "first_id": pa.array([], pa.int64()), "ids": pa.array([], pa.list_(pa.field("element", pa.int64())))})
        if not held.num_rows or not asked.num_rows:
            return empty
        x, first, leaf, q, qid, out = vectors.matrix(held["v"]), held["first_id"].to_numpy(), held["leaf"].to_numpy() % BIN, vectors.matrix(asked["v"]), asked["cid"].to_numpy(), []
        lists = asked["leaves"].combine_chunks()
        open_ = np.zeros((len(q), BIN), bool)
        open_[np.repeat(np.arange(len(q)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy() % BIN] = True
        ids = held["ids"].combine_chunks()
        for at in range(0, len(q), 256):
            for i, score in enumerate(q[at : at + 256] @ x.T, at):
                own = np.flatnonzero(open_[i, leaf])
                top = own[_top(score[own], first[own], k)]
                out.append((np.full(len(top), qid[i]), np.einsum("ij,j->i", x[top], q[i]), top))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pa.table({"qid": a, "score": b, "first_id": first[c], "ids": ids.take(pa.array(c)).cast(pa.list_(pa.field("element", pa.int64())))})

    key = ("bin", "bv", "bq")
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(compare, "qid long, score double, first_id long, ids array<long>")
