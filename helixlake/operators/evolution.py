"""Replicate-aware statistics of a selection campaign, from reads (variant, family, round, replicate, reads)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixlake.functions import mathx as m
from helixlake.session import small

PSEUDOCOUNT = 1.0


def interval(df: DataFrame, by: list[str], value: str, prefix: str) -> DataFrame:
    """Mean over replicates with a 95 % t interval: {prefix}_mean, _lower (not below 0), _upper, _sem."""
    g = df.groupBy(*by).agg(F.avg(value).alias("a"), F.stddev_samp(value).alias("sd"), F.count(value).alias("n"))
    sem = F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("sd", F.lit(0.0)) / F.sqrt("n"))
    half = F.when(F.col("n") < 2, 0.0).otherwise(m.t_critical(F.col("n") - 1) * sem)
    low = F.when(F.col("n") < 2, F.col("a")).otherwise(F.greatest(F.lit(0.0), F.col("a") - half))
    return g.select(*by, F.col("a").alias(f"{prefix}_mean"), low.alias(f"{prefix}_lower"), (F.col("a") + half).alias(f"{prefix}_upper"), sem.alias(f"{prefix}_sem"), F.col("n").alias("replicates"))


def replicate_frequencies(reads: DataFrame) -> DataFrame:
    """(variant, family, round, replicate, reads, freq): every combination there can be, smoothed by a pseudocount.

    The denominator adds one pseudocount for each variant that the round has seen.
    """
    totals = reads.groupBy("round", "replicate").agg(F.sum("reads").alias("total"))
    seen = reads.groupBy("round").agg(F.count_distinct("variant").alias("n_variants"))
    grid = reads.select("variant", "family").distinct().crossJoin(small(totals))  # every combination is asked for
    full = grid.join(reads.select("variant", "round", "replicate", "reads"), ["variant", "round", "replicate"], "left").join(seen, "round")
    return full.select("variant", "family", "round", "replicate", F.coalesce("reads", F.lit(0)).alias("reads"), ((F.coalesce("reads", F.lit(0)) + PSEUDOCOUNT) / (F.col("total") + PSEUDOCOUNT * F.col("n_variants"))).alias("freq"))


def variant_frequency(reads: DataFrame) -> DataFrame:
    """Frequency of every variant in every round with its interval, and its total reads there."""
    f = replicate_frequencies(reads)
    return interval(f, ["variant", "round"], "freq", "freq").join(f.groupBy("variant", "round").agg(F.sum("reads").alias("reads")), ["variant", "round"])


def diversity_curve(reads: DataFrame) -> DataFrame:
    """Shannon bits and top share per round, over replicates renormalised after smoothing; effective and observed variants."""
    f = replicate_frequencies(reads)
    f = f.withColumn("p", F.col("freq") / F.sum("freq").over(Window.partitionBy("round", "replicate")))
    per = f.groupBy("round", "replicate").agg(F.sum(m.shannon_bits(F.col("p"))).alias("h"), F.max("p").alias("top"))
    observed = reads.where("reads > 0").groupBy("round").agg(F.count_distinct("variant").alias("observed"))
    h, top = interval(per, ["round"], "h", "shannon"), interval(per, ["round"], "top", "top").drop("replicates")
    return h.join(top, "round").join(observed, "round", "left").withColumn("effective", F.pow(F.lit(2.0), "shannon_mean")).withColumn("observed", F.coalesce("observed", F.lit(0)))


def family_share(reads: DataFrame) -> DataFrame:
    """Share of each family in each round: sums per replicate, their mean, renormalised over families."""
    sums = replicate_frequencies(reads).groupBy("family", "round", "replicate").agg(F.sum("freq").alias("s"))
    mean = sums.groupBy("family", "round").agg(F.avg("s").alias("mean"))
    return mean.select("family", "round", m.ratio("mean", F.sum("mean").over(Window.partitionBy("round"))).alias("share"))


def enrichment(reads: DataFrame, wild_type: str) -> DataFrame:
    """Per variant but the wild type: log2 against the wild type in the last round and against the first round,
    the mean of ln(f_t / f_t-1), and the last frequency with its interval."""
    f = variant_frequency(reads)
    w = Window.partitionBy("variant").orderBy("round")
    step = F.lag("freq_mean").over(w)
    f = f.withColumns({"s": F.when((step > 0) & (F.col("freq_mean") > 0), F.log(F.col("freq_mean") / step)), "first": F.first("freq_mean").over(w), "back": F.row_number().over(Window.partitionBy("variant").orderBy(F.desc("round")))})
    mean = f.groupBy("variant").agg(F.coalesce(F.avg("s"), F.lit(0.0)).alias("selection"))
    last = f.where("back = 1")
    wild = last.where(F.col("variant") == wild_type).agg(F.max("freq_mean").alias("wild"))
    out = last.where(F.col("variant") != wild_type).join(mean, "variant").crossJoin(F.broadcast(wild))  # one row
    versus = F.when(F.col("wild") > 0, m.safe_log2(F.try_divide("freq_mean", "wild"))).otherwise(m.safe_log2("freq_mean"))
    return out.select("variant", versus.alias("log2_vs_wild"), m.safe_log2(F.col("freq_mean") / F.greatest("first", F.lit(1e-9))).alias("log2_across"), "selection", F.col("freq_mean").alias("final"), F.col("freq_lower").alias("final_lower"), F.col("freq_upper").alias("final_upper"), F.col("reads").alias("final_reads"))


def peak_frequency(reads: DataFrame) -> DataFrame:
    return variant_frequency(reads).groupBy("variant").agg(F.max("freq_mean").alias("peak"))


def top_variants(reads: DataFrame, wild_type: str, k: int = 6) -> DataFrame:
    """The k variants with the highest peak, the wild type left out."""
    return peak_frequency(reads).where(F.col("variant") != wild_type).orderBy(F.desc("peak"), "variant").limit(k)


def campaign_summary(reads: DataFrame) -> DataFrame:
    """One row: last round, its Shannon bits and top share, and the change of bits from the round before."""
    d = diversity_curve(reads).withColumn("before", F.lag("shannon_mean").over(Window.orderBy("round")))  # a row per round
    return d.orderBy(F.desc("round")).limit(1).select("round", "shannon_mean", "top_mean", F.coalesce(F.col("shannon_mean") - F.col("before"), F.lit(0.0)).alias("shannon_delta"))


def survivor_diversity(members: DataFrame) -> DataFrame:
    """Families of survivors (family): count, dominant share and normalised Shannon with its class."""
    g = members.groupBy("family").count()
    t = g.agg(F.count("*").alias("families"), F.sum("count").alias("n"), F.max("count").alias("top"), F.sum(F.col("count") * F.log2("count")).alias("s"))
    bits = F.log2("n") - F.col("s") / F.col("n")
    norm = F.when(F.col("families") > 1, bits / F.log2("families")).otherwise(0.0)
    return t.select("families", (F.col("top") / F.col("n")).alias("dominant_share"), norm.alias("evenness"), F.when(norm >= 0.75, "broad").when(norm >= 0.4, "focused").otherwise("collapsed").alias("kind"))


def mutation_persistence(mutations: DataFrame, at_least: int) -> DataFrame:
    """Mutations (variant, mutations array) found in ``at_least`` variants, the most frequent first."""
    return mutations.select("variant", F.explode(F.array_distinct("mutations")).alias("mutation")).groupBy("mutation").count().where(F.col("count") >= at_least).orderBy(F.desc("count"), "mutation")


def selection_density(members: DataFrame) -> DataFrame:
    """Each selected variant's family share among the selected."""
    sizes = members.groupBy("family").agg(F.count("*").alias("n"))
    total = sizes.agg(F.sum("n").alias("total"))
    return members.join(sizes.crossJoin(F.broadcast(total)), "family").select("variant", "family", (F.col("n") / F.col("total")).alias("density"))
