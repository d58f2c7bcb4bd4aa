"""Design ranking: Pareto fronts, scores, risk flags, survivors, schedules, nearest parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m

#: Weights of a variant's terms and penalties.
WEIGHTS = {"activity": 0.38, "stability": 0.24, "expression": 0.14, "specificity": 0.12, "burden": 3.7, "risk": 4.4}
#: (control gain, part, strength). Parts of the public registry.
RBS = [
    (0.0, "B0030", 0.07), (0.1, "B0031", 0.12), (0.2, "B0032", 0.30), (0.3, "B0033", 0.01), (0.4, "B0034", 1.00), (0.5, "B0035", 0.50),
    (0.6, "J61100", 0.20), (0.7, "J61101", 0.40), (0.8, "J61104", 0.60), (0.9, "J61106", 0.80), (1.0, "J61107", 0.90),
]
#: (gene, essential, knock-down efficiency, growth impact). Fixed values.
KNOCKDOWN_TARGETS = [
    ("gapA", True, 0.0, -1.00), ("gpmA", True, 0.0, -1.00), ("eno", True, 0.0, -1.00), ("pykF", False, 0.92, -0.18), ("pykA", False, 0.88, -0.08), ("zwf", False, 0.95, -0.12),
    ("pfkA", False, 0.85, -0.15), ("pfkB", False, 0.78, -0.04), ("aceA", False, 0.91, -0.06), ("aceB", False, 0.89, -0.05), ("ppc", False, 0.94, -0.20), ("pckA", False, 0.82, -0.03),
    ("maeB", False, 0.76, -0.02), ("sdhA", False, 0.88, -0.11), ("sucA", False, 0.90, -0.14), ("glk", False, 0.72, -0.09), ("pta", False, 0.85, -0.05), ("ackA", False, 0.83, -0.04),
    ("ldhA", False, 0.96, -0.01), ("adhE", False, 0.93, -0.01),
]


def variant_scores(rows: DataFrame, weights: dict[str, float], wild_type: float = 55.0) -> DataFrame:
    """Adds ``composite`` in 0..100, its difference from the wild type, and risk flags to (activity, stability, expression, specificity, burden, risk)."""
    c = F.col
    good = sum((c(n) / 100 * weights[n] * 100 for n in ("activity", "stability", "expression", "specificity")), F.lit(0.0))
    composite = m.clamp(m.js_round(good - c("burden") * weights["burden"] - c("risk") * weights["risk"], 2), 0.0, 100.0)
    flags = F.array(
        F.when(c("stability") < 46, "stability floor"), F.when(c("expression") < 48, "expression drag"), F.when(c("burden") >= 4, "mutation burden"),
        F.when((c("stability") < 42) & (c("burden") >= 3), "aggregation risk"),
    )
    out = rows.withColumn("composite", composite).withColumn("delta", m.js_round(F.col("composite") - wild_type, 2))
    return out.withColumn("flags", F.filter(flags, lambda f: f.isNotNull()))


def pareto_front(rows: DataFrame, goals: list[str], within: str, key: str) -> DataFrame:
    """The rows of each group that no other one dominates (as good in every goal, better in one); equal rows stay.

    Every partition first drops what its own rows dominate, so that only local fronts are shuffled; those of
    a group are then compared in one small table.
    """
    import numpy as np
    import pandas as pd

    def front(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(goals, ascending=False, kind="stable")  # a row can only be dominated by one before it
        kept, values = [], np.empty((0, len(goals)))
        for place, v in enumerate(pdf[goals].to_numpy(float)):
            if not ((values >= v).all(1) & (values > v).any(1)).any():
                kept.append(place)
                values = np.vstack([values, v])
        return pdf.iloc[kept]

    def local(frames):
        for frame in frames:
            yield pd.concat([front(g) for _, g in frame.groupby(within)]) if len(frame) else frame

    own = rows.select(key, within, *goals)
    return own.mapInPandas(local, own.schema).groupBy(within).applyInPandas(front, own.schema)


def pareto_ranks(rows: DataFrame, goals: list[str], within: str, key: str, most: int = 3) -> DataFrame:
    """Adds ``rank``: 0 for the front, 1 for the front of the rest and so on, below ``most``."""
    out, left = None, rows
    for rank in range(most):
        front = pareto_front(left, goals, within, key).withColumn("rank", F.lit(rank))
        out = front if out is None else out.unionByName(front)
        left = left.join(front.select(key), key, "left_anti")
    return out


def survivors(rows: DataFrame, n: int, stringency: float) -> DataFrame:
    """(variant, family, composite, stability, pass): ``n`` variants by composite, stability and id, some families first.

    The floor is 47 + 10 stringency. Pass 1 takes the best variant at most 3 below it from two families, or
    three for four survivors and more at a stringency under 0.62. Pass 2 fills up with variants above the floor or
    2 better than the n-th. Every step is a top-k.
    """
    order = [F.desc("composite"), F.desc("stability"), F.asc("variant")]
    floor = int((47 + stringency * 10) * 10 + 0.5) / 10
    families = 3 if n >= 4 and stringency < 0.62 else 2
    own = rows.select("variant", "family", "composite", "stability")
    best = own.where(F.col("stability") >= floor - 3).withColumn("k", F.row_number().over(Window.partitionBy("family").orderBy(*order))).where("k = 1").drop("k")
    first = best.orderBy(*order).limit(min(families, n)).withColumn("pass", F.lit(1))
    edge = own.orderBy(*order).limit(n).agg(F.min("composite").alias("edge"))
    rest = own.join(first.select("variant"), "variant", "left_anti").crossJoin(F.broadcast(edge)).where((F.col("stability") >= floor) | (F.col("composite") >= F.col("edge") + 2)).drop("edge")
    rest = rest.orderBy(*order).limit(n).withColumn("pass", F.lit(2))
    return first.unionByName(rest).orderBy("pass", *order).limit(n)


def knockdown_targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOCKDOWN_TARGETS, "gene string, essential boolean, efficiency double, growth_impact double")


def knockdown_schedule(targets: DataFrame, n: int, threshold: float, protect: bool = True) -> DataFrame:
    """The ``n`` targets with the highest efficiency + 0.3 (1 + growth impact), ties in the table's order."""
    score = F.col("efficiency") + (1 + F.coalesce("growth_impact", F.lit(0.0))) * 0.3
    own = targets.where(F.col("efficiency") >= threshold)
    own = own.where(~F.col("essential")) if protect else own
    return own.withColumn("score", score).orderBy(F.desc("score"), "gene").limit(n)


def schedule_metrics(schedule: DataFrame) -> DataFrame:
    return schedule.agg(F.count("*").alias("n"), F.sum("growth_impact").alias("growth"), F.avg("efficiency").alias("efficiency"), F.avg((F.col("efficiency") < 0.8).cast("double")).alias("low_share"))


def rbs_nearest(rows: DataFrame, gain: Column) -> DataFrame:
    """Adds the registry part whose control gain is nearest ``gain``, held within 0..1; the first of equals."""
    parts = F.array(*[F.struct(F.lit(g).alias("gain"), F.lit(p).alias("part"), F.lit(s).alias("strength"), F.lit(i).alias("ord")) for i, (g, p, s) in enumerate(RBS)])
    own = m.clamp(gain, 0.0, 1.0)
    best = F.array_min(F.transform(parts, lambda p: F.struct(F.abs(p["gain"] - own).alias("d"), p["ord"].alias("ord"), p["part"].alias("part"), p["strength"].alias("strength"))))
    return rows.withColumn("gain", m.js_round(own, 3)).withColumn("_b", best).withColumns({"part": F.col("_b.part"), "strength": F.col("_b.strength")}).drop("_b")


def combined_gain(kp: Column, ki: Column, kd: Column) -> Column:
    return kp / 10 * 0.5 + ki / 5 * 0.3 + kd / 2 * 0.2


def landscape(spark: SparkSession, size: int = 20) -> DataFrame:
    """(i, j, fitness): a grid of three Gaussian peaks with a ripple."""
    at = lambda c: (F.col(c) / (size - 1)).alias(c + "_")
    g = spark.range(size).select(F.col("id").cast("int").alias("i")).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).select("i", "j", at("i"), at("j"))
    bump = lambda x, y, s, h: h * F.exp(-(F.pow(F.col("i_") - x, F.lit(2.0)) + F.pow(F.col("j_") - y, F.lit(2.0))) / (2 * s * s))
    return g.select("i", "j", (bump(0.3, 0.3, 0.15, 0.6) + bump(0.7, 0.6, 0.2, 1.0) + bump(0.2, 0.8, 0.1, 0.4) + 0.05 * F.sin(F.col("i_") * 12) * F.cos(F.col("j_") * 12)).alias("fitness"))
