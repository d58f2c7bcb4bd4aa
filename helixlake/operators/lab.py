"""Laboratory bookkeeping: plates, labware, volumes, benchmark lookup, campaign reads, queue folding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import hashing, mathx as m, text as x


def unique_ids(rows: DataFrame, base: str, order: str) -> DataFrame:
    """Adds ``unique_id``: the base, with _2, _3, ... from the second row of the same base on."""
    n = F.row_number().over(Window.partitionBy(base).orderBy(order))
    return rows.withColumn("unique_id", F.when(n == 1, F.col(base)).otherwise(F.concat(base, F.lit("_"), n.cast("string"))))


def scaled_steps(steps: DataFrame, wells: int) -> DataFrame:
    """Every step (step, source, volume) once per well, with the well's name."""
    w = F.explode(F.sequence(F.lit(0), F.lit(wells - 1)))
    return steps.select("step", "source", "volume", w.alias("well_index")).withColumn("well", x.well_name(F.col("well_index")))


def source_volumes(steps: DataFrame, dead: float = 0.0) -> DataFrame:
    """Initial volume per source: the sum of what is drawn and a dead volume."""
    return steps.groupBy("source").agg((F.sum("volume") + dead).alias("volume"))


def step_violations(steps: DataFrame, smallest: float, largest: float) -> DataFrame:
    """(step, problem) of steps whose volume the pipette can't move."""
    bad = F.when(F.col("volume") < smallest, "below range").when(F.col("volume") > largest, "above range")
    return steps.select("step", bad.alias("problem")).where("problem IS NOT NULL")


def benchmark_lookup(targets: DataFrame, benchmarks: DataFrame) -> DataFrame:
    """(target, benchmark): the first benchmark (ord, alias, name) one of whose aliases the normalised target contains.

    Words of the aliases are joined with words of the targets; the containment is checked on those pairs only.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    t = targets.select("target", clean(F.col("target")).alias("t"))
    b = benchmarks.select("ord", "name", clean(F.col("alias")).alias("a")).where("a <> ''")
    words = t.select("target", "t", F.explode(F.array_distinct(F.split("t", " "))).alias("w")).join(b.withColumn("w", F.split("a", " ")[0]), "w")
    hit = words.where(F.contains(F.concat(F.lit(" "), "t", F.lit(" ")), F.concat(F.lit(" "), F.col("a"), F.lit(" "))))
    return hit.groupBy("target").agg(F.min_by("name", "ord").alias("benchmark"))


def campaign_reads(scores: DataFrame, depth: float) -> DataFrame:
    """(variant, round, replicate, reads): shares by squared score times depth, with a noise of 8 % hashed from the key, rounded half up."""
    total = F.sum(F.col("score") * F.col("score")).over(Window.partitionBy("round", "replicate"))
    u = hashing.fnv1a(F.concat_ws(":", *[F.col(c).cast("string") for c in ("variant", "round", "replicate")])) / 4294967296.0
    reads = m.ratio(F.col("score") * F.col("score"), total) * depth * (1 + (u - 0.5) * 0.16)
    return scores.select("variant", "round", "replicate", m.js_round(reads).cast("long").alias("reads"))


def queue_state(events: DataFrame) -> DataFrame:
    """(task, status, attempts): a task's events (task, seq, event) folded in order; moves that don't fit are ignored."""
    rules = [("pending", "run", "running"), ("running", "done", "done"), ("running", "fail", "error"), ("pending", "cancel", "cancelled"), ("running", "cancel", "cancelled"), ("error", "retry", "pending")]

    def step(acc, e):
        to = acc["status"]
        for a, event, b in rules:
            to = F.when((acc["status"] == a) & (e["event"] == event), b).otherwise(to)
        return F.struct(to.alias("status"), (acc["attempts"] + F.when((acc["status"] == "pending") & (e["event"] == "run"), 1).otherwise(0)).alias("attempts"))

    own = events.groupBy("task").agg(F.array_sort(F.collect_list(F.struct("seq", "event"))).alias("log"))
    state = F.aggregate("log", F.struct(F.lit("pending").alias("status"), F.lit(0).alias("attempts")), step)
    return own.select("task", state.alias("s")).select("task", "s.*")


def family_hotspots(variants: DataFrame) -> DataFrame:
    """(family, n, x, y, score) of each family in the latest round."""
    last = variants.agg(F.max("round").alias("round"))  # one row
    own = variants.join(F.broadcast(last), "round", "left_semi")
    return own.groupBy("family").agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"), F.avg("score").alias("score"))


def sampled_silhouette(cells: DataFrame, most: int = 200) -> DataFrame:
    """(n, silhouette): mean silhouette of the ``most`` cells that come first by the digest of their id, against all cells.

    Distances are Euclidean; the sample is bounded by its parameter, so every cell meets it and no other cell.
    A cell alone in its cluster has distance 0 to it, and so has a cell to others where there is one cluster only.
    """
    sample = cells.orderBy(F.md5(F.col("cell").cast("string").cast("binary")), "cell").limit(most).select(F.col("cell").alias("at"), F.col("cluster").alias("own"), F.col("v").alias("w"))
    met = cells.crossJoin(F.broadcast(sample)).where("at <> cell").select("at", "own", "cluster", m.distance(F.col("v"), F.col("w")).alias("d"))
    mean = met.groupBy("at", "own", "cluster").agg(F.avg("d").alias("d"))
    near = mean.groupBy("at").agg(F.max(F.when(F.col("own") == F.col("cluster"), F.col("d"))).alias("a"), F.min(F.when(F.col("own") != F.col("cluster"), F.col("d"))).alias("b"))
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    top = F.greatest(a, b)
    return near.agg(F.count("*").alias("n"), F.coalesce(F.avg((b - a) / F.when(top == 0, 1.0).otherwise(top)), F.lit(0.0)).alias("silhouette"))
