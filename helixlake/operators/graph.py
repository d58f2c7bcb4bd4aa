"""Graph operators over edges (a, b, kind, mode): closures, traces, runnable tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.session import cut


def edges_of(edges: DataFrame, kinds: tuple[str, ...] = ("forward", "feedback"), mode: str | None = None) -> DataFrame:
    e = edges.where(F.col("kind").isin(*kinds))
    return e.where(F.col("mode") == mode) if mode else e


def closure(edges: DataFrame, most: int = 64) -> DataFrame:
    """(a, b, hops): every node b that can be reached from a, and by how few edges; cycles are fine.

    A frontier of new pairs is joined with the edges until it is empty; pairs known already don't come back.
    """
    known = cut(edges.select("a", "b").distinct().withColumn("hops", F.lit(1)))
    front, step = known, edges.select(F.col("a").alias("b"), F.col("b").alias("to")).distinct()
    for hops in range(2, most + 1):
        new = front.join(step, "b").select("a", F.col("to").alias("b")).distinct().join(known, ["a", "b"], "left_anti")
        front = cut(new.withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            return known
        known = cut(known.unionByName(front))
    raise RuntimeError(f"the closure is deeper than {most} edges")


def upstream(edges: DataFrame, node: str) -> DataFrame:
    return closure(edges).where((F.col("b") == node) & (F.col("a") != node)).select(F.col("a").alias("node"), "hops")


def downstream(edges: DataFrame, node: str) -> DataFrame:
    return closure(edges).where((F.col("a") == node) & (F.col("b") != node)).select(F.col("b").alias("node"), "hops")


def trace(edges: DataFrame, node: str) -> DataFrame:
    """(place, node): what is upstream, farthest first, the node itself at 0, and what is downstream."""
    up, down = upstream(edges, node), downstream(edges, node)
    own = up.select((-F.col("hops")).alias("place"), "node").union(down.select("hops", "node")).union(edges.sparkSession.createDataFrame([(0, node)], "place int, node string"))
    return own


def next_required(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("a") == node) & (F.col("kind") == "forward") & (F.col("mode") == "required")).select(F.col("b").alias("node"))


def incident(edges: DataFrame, node: str) -> DataFrame:
    return edges.where((F.col("a") == node) | (F.col("b") == node))


def node_flux(edges: DataFrame) -> DataFrame:
    """(node, magnitude): mean absolute flux of the edges at a node."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("node"), F.abs("flux").alias("f"))
    return ends.groupBy("node").agg(F.avg("f").alias("magnitude"))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are nodes."""
    return edges.join(nodes.select(F.col("id").alias("a")), "a", "left_semi").join(nodes.select(F.col("id").alias("b")), "b", "left_semi").select(edges.columns)


def unique_edges(edges: DataFrame) -> DataFrame:
    """The first edge (by ord) of each (role, a, relation, b, direction)."""
    key = ["role", "a", "relation", "b", "direction"]
    return edges.withColumn("k", F.row_number().over(Window.partitionBy(*key).orderBy("ord"))).where("k = 1").drop("k")


def runnable(tasks: DataFrame) -> DataFrame:
    """Pending tasks (task, status, depends_on) whose dependencies are all done; unknown ones block."""
    needs = tasks.where("status = 'pending'").select("task", F.explode_outer("depends_on").alias("need"))
    done = tasks.where("status = 'done'").select(F.col("task").alias("need"))
    open_ = needs.where("need IS NOT NULL").join(done, "need", "left_anti").select("task").distinct()
    return tasks.where("status = 'pending'").join(open_, "task", "left_anti").select("task")


def blocked_by_failure(tasks: DataFrame) -> DataFrame:
    """Pending tasks with a failed or cancelled dependency."""
    bad = tasks.where("status IN ('error', 'cancelled')").select(F.col("task").alias("need"))
    return tasks.where("status = 'pending'").select("task", F.explode("depends_on").alias("need")).join(bad, "need", "left_semi").select("task").distinct()


def lineage(variants: DataFrame) -> DataFrame:
    """(variant, children, status): status by precedence wild-type, lead, survivor, dead, rejected."""
    kids = variants.where("parent IS NOT NULL").groupBy(F.col("parent").alias("variant")).agg(F.count("*").alias("children"))
    status = F.when(F.col("is_wild"), "wild-type").when(F.col("is_lead"), "lead").when(F.col("survived"), "survivor").when(F.coalesce("children", F.lit(0)) == 0, "dead").otherwise("rejected")
    return variants.join(kids, "variant", "left").select("variant", F.coalesce("children", F.lit(0)).alias("children"), status.alias("status"))
